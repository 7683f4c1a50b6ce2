"""Known licence texts and notices: fixed values."""

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""

_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""

_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: With and without a title line.
LICENSES = {
    "MIT": _MIT,
    "MIT (titled)": f"MIT License\n\n{_MIT}",
    "MIT (titled, the)": f"The MIT License\n\n{_MIT}",
    "ISC": _ISC,
    "ISC (titled)": f"ISC License\n\n{_ISC}",
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-2-Clause (titled)": f"BSD 2-Clause License\n\n{_BSD_HEAD}{_BSD_TAIL}",
    "BSD-3-Clause": _BSD_HEAD + _BSD_THIRD + _BSD_TAIL,
    "BSD-3-Clause (titled)": f"BSD 3-Clause License\n\n{_BSD_HEAD}{_BSD_THIRD}{_BSD_TAIL}",
}

NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 (the licence)": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT (licensed)": "Licensed under the MIT License.",
}

#: SHA-256 of the canonical forms of longer licences, whole, or up to the end of their terms and conditions.
DIGESTS = {
    "Apache-2.0": "890175f2e81dae03626a98e35f6e227b9af3421ef35bfb554592a71ed676eaa9",
    "Apache-2.0 (terms)": "a07acaafbbd3efc89d910f8dc1c26425d3f82b06862987646e0b48edb9ca7c27",
    "Artistic-1.0-Perl": "698ed693149f86edbe1d0e774a55f8f4e126b3ad65eef3ce26cf88e86d7f7970",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "6e351e5fc9bf60ba1b91b50d0e5a325521dd64f969cf262a2fc93cbbf7047656",
    "GFDL-1.3": "68317d5a5d1566744f98c79d9b5c852f37fd35a564321a3e1d67c6e85b2f2d4d",
    "GPL-1.0": "c99c820668a8e870b9ab2d3fde5095f0fc8d8fce7728a0dac7c485018d22649e",
    "GPL-1.0 (terms)": "ae5d2ab6f0f0f9507e89deea86ac06bed22205f840c80316d04c2cf1c73f251d",
    "GPL-2.0": "d1fa61212ae86f10c1b0ea5c8db2b3512d73899ca35873143cc967722492e2b6",
    "GPL-2.0 (terms)": "1e95e2d233ff8561dbfd49ec57a5544482a8cc2f9016994498703cf747ecfce1",
    "GPL-3.0": "e062d7afd5abe9c5675d9147fe3d36e8d8fd995979f3686038eef96b5c07ea80",
    "GPL-3.0 (terms)": "46e99e25e92b66359c6331c636ec7a0dc3b95e7daa4f0ed054dbc24be1a87cd4",
    "LGPL-2.0": "a888d77e6cc8e53e11ee3ed23bccf3baaabdb48b46cd0cd50afaae864da4e6b3",
    "LGPL-2.0 (terms)": "ee00b0b43667799dc552a96dce9a9ff56093ac70d61c154d972f50660201f887",
    "LGPL-2.1": "f8b1d38ac8ea665fe831af3585b7a2308e9b913f9b67be6f8b9716d7bb485690",
    "LGPL-2.1 (terms)": "148e6979390d985bdd83fe6868101f4c9960e9978dac9c2c3175ea129fdad619",
    "LGPL-3.0": "b9d017245d5b6307f6fc2b6dc02be9744eb7e632f313cf7b809a2cd3996db0f6",
    "MPL-1.1": "ea86b8706eaa54ae6772e73b8999c32089d18d7d1f9daa08fae518eaecfcbc61",
    "MPL-2.0": "50bee64b2a602a124fade3ae9610b3f3c9bce8184489f1c5a76646a64c53f7c5",
}
