"""Scalar and ordering expressions shared by all operators."""
