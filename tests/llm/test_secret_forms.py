"""Labelled secrets of forms that length caps and quoted names used to lose: (before, secret, after, kind)."""

import base64
import random

import pytest

from tidewright.llm import secrets

LONG = base64.b64encode(random.Random(1).randbytes(1200)).decode()
KEY = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(LONG[k : k + 64] for k in range(0, len(LONG), 64)) + "\n-----END RSA PRIVATE KEY-----"
FORMS = [
    ("see ", LONG[:513], " here", "bare"),
    ("see ", LONG, " here", "bare"),
    ('private_key = "', LONG, '"', "assigned"),
    ("", "ghp_" + "a1B2" * 100, " x", "prefixed"),
    ("", "xoxb-" + "1a2b-" * 80 + "9", " x", "prefixed"),
    ("", "sk_live_" + "a1B2" * 100, " x", "prefixed"),
    ("x\n", KEY, "\ny", "header"),
    ('private_key = "', KEY, '"', "header"),
    ("", "-----BEGIN PRIVATE KEY-----", "\nnothing more", "header"),
    ('{"password": "', "Hunter2-abc9", '"}', "assigned"),
    ("cfg['api_key'] = '", "Zk3vQ9xLm2Tq8w", "'", "assigned"),
]


@pytest.mark.parametrize("before, secret, after, kind", FORMS)
def test_the_whole_secret_is_one_candidate(before, secret, after, kind):
    assert secrets.candidates(before + secret + after) == [(kind, len(before), len(before) + len(secret))]


def test_a_key_ends_before_the_next_begins():
    head = "-----BEGIN PRIVATE KEY-----\n"
    found = secrets.candidates(head + KEY)
    assert [(k, a, e) for k, a, e in found if k == "header"] == [("header", 0, len(head) - 1), ("header", len(head), len(head) + len(KEY))]
