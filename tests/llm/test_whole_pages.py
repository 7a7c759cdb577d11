"""Pages whose text must not be lost."""

from __future__ import annotations

from lumenforge.llm import html_extract


def test_head_without_end_tag_or_body():
    for page in ("<head><title>T</title><article><p>One two.</p></article>", "<head><meta charset=x><p>One two."):
        _, blocks = html_extract.parse(page)
        assert "One two." in " ".join(str(b[1]) for b in blocks)
        assert "T" not in " ".join(str(b[1]) for b in blocks).replace("One two.", "")
