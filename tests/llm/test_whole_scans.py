"""Spans that the scans of secrets and personal data must not lose."""

from __future__ import annotations

import pyarrow as pa
import pytest

from lumenforge.llm import pii, secrets

TAGGER = pii.Tagger(pii.training_table())


@pytest.mark.parametrize("value", ["QxTzRbLmWpNkHsVd", "QxTzRbLm", "qxtzrblmwpnkhsvd", "Zq!rT#vLp", "Zq8rT2vL9p"])
@pytest.mark.parametrize("name", ["pwd: ", "passphrase = ", "private_key: ", "Authorization: Bearer "])
def test_secret_without_digits(name, value):
    text = f"see {name}{value} here"
    assert secrets.guessed_spans(text, 8.0)[0] == [(4 + len(name), 3, 4 + len(name) + len(value))]


def test_words_after_a_name_are_no_secret():
    for text in ("auth: required", "authorization: Bearer", "credentials: see below", "pwd: password", "pass: PLEASE!"):
        assert secrets.scan_batch(pa.array([text]), 8.0)[0][5] == 0, text


@pytest.mark.parametrize("text, span", [
    ("Phone:\n(415) 555-0132", "tel:7:21"),
    ("Ana Ruiz\n123-45-6789\nBerlin", "id:9:20"),
    ("anna [at] web [dot] de", "mailbox:0:22"),
    ("IBAN:\n\nDE12 3456 7890 1234 5678 90", "id:7:34"),
    ("anna chez web point fr", "mailbox:0:22"),
])
def test_personal_data_that_no_word_of_its_line_announces(text, span):
    assert span in pii.scan_batch(pa.array([text]), TAGGER)[0][5].split(",")
