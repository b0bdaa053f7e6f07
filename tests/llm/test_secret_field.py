"""The secret field begins at any token of key characters, and skips only what is outside on the best path."""

import numpy as np
import pytest

pytest.importorskip("tessera.llm")
from tessera.llm import secret_scan  # noqa: E402


def whole_text(text, field, base):
    t, file = secret_scan.tokens(text), secret_scan.file_features(text, base)
    out, was = [], 0
    for x, s, tag in zip(t.text, t.start, field.tags(t, [secret_scan.token_features(t, i, file, {}) for i in range(len(t.text))]), strict=True):
        if tag == 1:
            out.append((s, s + len(x)))
        elif tag == 2 and was:
            out[-1] = (out[-1][0], s + len(x))
        was = tag if tag < 2 else was
    return out


def test_letters_and_short_values_are_found():
    field = secret_scan.train(["token = \"" + "ab12" * 10 + "\" x", "plain words only 12 times, and some more of them for the tokens of love."])
    for text, secret in (('x pwd = "CorrectHorseBatteryStaple" y', "CorrectHorseBatteryStaple"), ("my passphrase: hunter2 ok", "hunter2"), ("Authorization: Bearer abcdefGHIJKLmnopqrstUVWX ok", "abcdefGHIJKLmnopqrstUVWX")):
        assert [text[a:b] for a, b, _ in secret_scan.all_spans(text, field, {})[1]] == [secret]
    assert secret_scan.field_spans("the password is required for the key to success", field, [], {}) == []


def test_skipping_equals_viterbi_over_the_whole_text():
    rng = np.random.default_rng(8)
    pieces = ["pwd", "=", ":", '"', "hunter2", "Ab1/9x", "word", "é", "secret", " ", " ", "\n", " ", "a1b2c3d4e5", "==", "(", ".", "the.", "\x1f"]
    for k in range(60):
        field = secret_scan.Field(rng.normal(size=(1 << secret_scan.BITS, 3)) * 0.4, rng.normal(size=(3, 3)))
        field.emit[:, 0] += k % 4 * 0.15
        memo = {}
        for _ in range(4):
            text = "".join(rng.choice(pieces, rng.integers(0, 60)))
            assert [s[:2] for s in secret_scan.field_spans(text, field, [], memo)] == whole_text(text, field, [])
