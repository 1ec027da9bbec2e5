"""Literals in more of the syntax of source and configuration, and constants put together from them."""

from __future__ import annotations

import time

import pytest
from graphloom.llm import secrets

KEY = "q8Zr71LmX0pTvv"


def found(text):
    return [text[s:e] for s, _, e in secrets.all_spans(text)[1]]


@pytest.mark.parametrize(
    "text",
    [
        f"cfg['signing_key'] = '{KEY}'",
        f'cfg["a"]["client_secret"] = "{KEY}"',
        f'const signingKey: string = "{KEY}"',
        f'#define SIGNING_KEY "{KEY}"',
        f'  # define SIGNING_KEY ("{KEY}")',
        f'signing_key = """{KEY}"""',
        f"signing_key = '''\n  {KEY}\n'''\nother = 1",
        f"signing_key: |\n  {KEY}\nother: 1",
        f"  private_key: >-\n    {KEY}\n  other: 1",
        f'signing_key = ("{KEY}")',
        f'#define K "{KEY}"\nint signing_key = K;',
    ],
)
def test_syntax(text):
    assert found(text) == [KEY]
    assert KEY not in secrets.redacted(text)


@pytest.mark.parametrize(
    "text",
    [
        'signing_key = "aB3d" + "E5gH7jK9" + "mN2qX7"',
        'a = "aB3d"\nb = "E5gH7jK9"\nprivate_key = a + b + "mN2qX7"',
        'a = "aB3d"\na += "E5gH7jK9"\na += "mN2qX7"\nauth_token = a',
        'signing_key = ("aB3d" "E5gH7jK9" "mN2qX7")',
    ],
)
def test_constants_count_as_a_whole(text):
    assert found(text) == ["aB3d", "E5gH7jK9", "mN2qX7"]


def test_only_what_a_sensitive_name_gets():
    assert found('a = "aB3dE5gH7jK9mN2q"\nb = a + "tail"\ncolour = b') == []
    assert found('endpoint_token_url = "https://" + "example.org/aB3dE5gH7jK9"') == []
    assert found("notes: |\n  aB3dE5gH7jK9mN2q\n") == []


def test_combined_constants_take_linear_time():
    def seconds(text):
        t = time.time()
        n = len(found(text))
        return time.time() - t, n

    double = f'x = "{KEY}"\n' + "x = x + x\n" * 1000 + "signing_key = x"
    took, n = seconds(double)
    assert n == 1 and took < 1
    chain = lambda k: f'x = "{KEY}"\n' + "".join(f'x = x + "p{i}"\nsigning_key{i} = x\n' for i in range(k))
    small, large = seconds(chain(4000))[0], seconds(chain(16000))[0]
    assert large < 8 * small + 0.2
    took, n = seconds("\n".join(f'password{k} = "aB3dE5gH7jK9{k}"' for k in range(20000)))
    assert n == 20000 and took < 5
