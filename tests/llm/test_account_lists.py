"""Account numbers that follow other numbers and codes."""

import pytest

from tidemark.llm import pii

GB, GB_SPACED, DE = "GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"


@pytest.mark.parametrize(
    ("text", "accounts"),
    [
        (f"{GB} {DE}", [GB, DE]),
        (f"{GB_SPACED} {GB_SPACED} {DE}", [GB_SPACED, GB_SPACED, DE]),
        (f"NR12 {GB_SPACED}", [GB_SPACED]),
        (f"DE12 {GB_SPACED} ABC", [GB_SPACED]),
        (f"GB82 WEST 1234 5698 7654 33 {DE}", [DE]),
        (f"X{GB} {GB}7 {GB}x", []),
    ],
)
def test_every_account_is_found(text, accounts):
    spans = pii.find_spans(text)
    assert [text[a:b] for kind, a, b, _ in spans if kind == "iban"] == accounts
    assert not any(a in pii.redact(text, spans) for a in accounts)
