"""Licence scan by canonical digests, in DataFrame functions only.

Texts are brought to one form (case, copyright lines, punctuation, white space, equivalent spellings),
and the SHA-256 of the whole form is hash-joined to the digests of known licences. Single lines of that
form are looked up among known notices.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import DIGESTS, LICENSES, NOTICES

#: (pattern, replacement, a word that a text to be changed has), in this order, on lower-case text. The patterns
#: mean the same to Java and to RE2; texts without the word are not searched.
STEPS = (
    (r"(^|\n)[ \t]*(copyright[ \t]*(\(c\)|©|\[|<)|copyright[^\n]*[0-9]{4}|©)[^\n]*", "\n", ("copyright", "©")),
    (r"(^|\n)[ \t]*(\(c\)[ \t]*(copyright|[0-9]{4})|all rights reserved)[^\n]*", "\n", ("(c)", "all rights reserved")),
    (r"[^a-z0-9\n ]+", " ", ()),
    (r"\blicence", "license", ("licence",)),
    (r"\bsublicence", "sublicense", ("sublicence",)),
    (r"\bauthoris", "authoriz", ("authoris",)),
    (r"\bunauthoris", "unauthoriz", ("unauthoris",)),
    (r"\borganis", "organiz", ("organis",)),
    (r"\bfavour", "favor", ("favour",)),
    (r"\bwhilst\b", "while", ("whilst",)),
    (r"\bversion +([0-9])", r"v\1", ("version ",)),
    (r" {2,}", " ", ("  ",)),
)
#: Steps after the lines are joined: what a line's end may have parted.
JOINED = ((r"\n", " ", ()), (r"\bversion +([0-9])", r"v\1", ("version ",)), (r" {2,}", " ", ()))


def canonical_lines(text: Column) -> Column:
    """The form of each line; lines can begin or end with a space."""
    return _stepped(F.lower(text), STEPS)


def _stepped(out: Column, steps) -> Column:
    for pattern, to, words in steps:
        # As a variable: a Column that each step uses three times would be written out three times for each step after it.
        out = F.element_at(F.transform(F.array(out), partial(_changed, pattern, to, words)), 1)
    return out


def _changed(pattern: str, to: str, words: tuple[str, ...], text: Column) -> Column:
    new = F.regexp_replace(text, pattern, to.replace("\\1", "$1"))
    if not words:
        return new
    has = F.lit(False)
    for w in words:
        has = has | text.contains(w)
    return F.when(has, new).otherwise(text)


def canonical(lines: Column) -> Column:
    """The form of the whole text, from its lines."""
    return F.trim(_stepped(lines, JOINED))


def known_digests(spark, texts: dict[str, str], digests: dict[str, str]) -> DataFrame:
    """(license_id, digest) of licence texts, and of licences of which only the digest is known; as many rows as are given."""
    rows = spark.createDataFrame(sorted(texts.items()), "license_id string, text string")
    made = rows.select("license_id", F.sha2(canonical(canonical_lines(F.col("text"))), 256).alias("digest"))
    given = spark.createDataFrame(sorted(digests.items()), "license_id string, digest string")
    return made.unionByName(given).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def _notices(lines: Column, notices: dict[str, str]) -> Column:
    """Ids of the lines that are notices; notices are few, so that they are part of the plan."""
    if not notices:
        return F.lit(None).cast("string")
    forms = dict(reversed([(_form(text), name) for name, text in sorted(notices.items())]))
    ids = F.create_map(*(F.lit(x) for pair in forms.items() for x in pair))
    known = F.filter(F.transform(F.split(lines, "\n"), lambda x: F.trim(x)), lambda x: x.isin(*forms))
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(F.transform(known, lambda x: F.element_at(ids, x)))), ","), F.lit(""))


def _form(text: str) -> str:
    """The form of one line, as canonical_lines has it."""
    import re

    out = text.lower()
    for pattern, to, _ in STEPS:
        out = re.sub(pattern, to, out)
    return out.strip(" ")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", licenses: dict[str, str] | None = None, notices: dict[str, str] | None = None, digests: dict[str, str] | None = None) -> DataFrame:
    """doc_id, digest, license_id, notice_ids for each row.

    license_id: the known licence that the whole text is, or null; of several with one form, the first by
    name. notice_ids: known notices (of one line each) that lines of the text are, sorted, without repeats,
    joined by commas; null if none. `licenses` and `notices`: texts by id; `digests`: SHA-256 of canonical
    forms by id. A null text has a null digest and neither; an empty one has the digest of nothing. Repeated
    rows and rows with null ids are judged alike, each by its own text; very long texts are taken whole; an
    empty table gives no rows. Other columns are ignored.
    """
    lines = canonical_lines(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), lines.alias("__lines"))
    rows = rows.select("doc_id", F.sha2(canonical(F.col("__lines")), 256).alias("digest"), _notices(F.col("__lines"), NOTICES if notices is None else notices).alias("notice_ids"))
    whole = known_digests(docs.sparkSession, LICENSES if licenses is None else licenses, DIGESTS if digests is None else digests)
    return rows.join(whole, "digest", "left").select("doc_id", "digest", "license_id", "notice_ids")


def _sql_steps(out: str, steps) -> str:
    for pattern, to, _ in steps:
        out = f"regexp_replace({out}, '{pattern}', {'chr(10)' if to == chr(10) else chr(39) + to + chr(39)}, 'g')"
    return out


def _sql_lines(text: str) -> str:
    return _sql_steps(f"lower({text})", STEPS)


def _sql_whole(lines: str) -> str:
    return f"trim({_sql_steps(lines, JOINED)})"


def oracle_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = lambda d: ", ".join(f"({quote(k)}, {quote(v)})" for k, v in sorted(d.items()))
    return f"""
    WITH known AS (SELECT id, sha256({_sql_whole(_sql_lines("t"))}) AS digest FROM (VALUES {values(LICENSES)}) v(id, t) UNION ALL SELECT * FROM (VALUES {values(DIGESTS)}) v(id, digest)),
    whole AS (SELECT digest, min(id) AS license_id FROM known GROUP BY 1),
    single AS (SELECT trim({_sql_lines("t")}) AS form, min(id) AS license_id FROM (VALUES {values(NOTICES)}) v(id, t) GROUP BY 1),
    c AS (SELECT doc_id, {_sql_lines("text")} AS lines FROM documents),
    each AS (SELECT doc_id, unnest(string_split(lines, chr(10))) AS line FROM c),
    found AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT license_id)), ',') AS notice_ids FROM each JOIN single ON trim(line) = form GROUP BY doc_id),
    d AS (SELECT doc_id, sha256({_sql_whole("lines")}) AS digest FROM c)
    SELECT d.doc_id, d.digest, whole.license_id, found.notice_ids FROM d LEFT JOIN whole USING (digest) LEFT JOIN found USING (doc_id)"""
