"""Secrets behind type annotations."""

from __future__ import annotations

import pytest
from graphloom.llm import secrets


@pytest.mark.parametrize(
    "text",
    [
        'api_key: str = "q8Zr71LmX0pTvv"',
        'self.api_key: Optional[str] = "q8Zr71LmX0pTvv"',
        'api_key: dict[str, str] | None = "q8Zr71LmX0pTvv"',
        "const password: string = 'q8Zr71LmX0pTvv';",
        "let token: string | undefined = `q8Zr71LmX0pTvv`",
        'const token string = "q8Zr71LmX0pTvv"',
        'var apiKey string = "q8Zr71LmX0pTvv"',
        'const clientSecret: Array<string> = "q8Zr71LmX0pTvv"',
        'K: str = "q8Zr71LmX0pTvv"\nclient.auth_key = K',
    ],
)
def test_annotated_assignments(text):
    assert "q8Zr71LmX0pTvv" in [text[s:e] for s, _, e in secrets.all_spans(text)[1]]
    assert "q8Zr71LmX0pTvv" not in secrets.redacted(text)


@pytest.mark.parametrize("text", ["name: str = 'q8Zr71LmX0pTvv'", "const label string = 'q8Zr71LmX0pTvv'", "password: str = None", 'token: str = ""'])
def test_annotated_assignments_of_other_names(text):
    assert secrets.all_spans(text)[1] == []
