import pytest

from flowlens.llm import pii


@pytest.mark.parametrize("account", ["DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19", "DE89370400440532013000",
                                     "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"])
@pytest.mark.parametrize("before", ["", "IBAN ", "AB12 ", "XX99 0000 "])
@pytest.mark.parametrize("after", ["", " BIC COBADEFFXXX", " BY friday", " I", " 12345", " 7 8 9", ".", " Friday", "\nNEXT"])
def test_an_account_ends_at_its_countrys_length(account, before, after):
    text = before + account + after
    assert [s[:3] for s in pii.spans(text) if s[0] == "iban"] == [("iban", len(before), len(before) + len(account))]


def test_two_accounts_and_rejected_ones():
    one, two = "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19"
    assert pii.redacted(f"{one} {two} END") == "<iban> <iban> END"
    found = lambda t: [s for s in pii.spans(t) if s[0] == "iban"]
    assert not found("DE89 3704 0044 0532 0130 01 BIC") and not found("DE893704004405320130007") and not found("xDE89370400440532013000")


def test_codes_without_a_length_end_at_a_word():
    rest = "1234567890123"
    check = next(f"{k:02d}" for k in range(2, 99) if pii.mod97(f"ZZ{k:02d}{rest}"))
    assert pii.redacted(f"to ZZ{check}{rest} by friday") == "to <iban> by friday"


def test_linear_on_long_runs():
    pii.spans("AB12 " * 60_000)
    pii.spans("DE89" + "A1 " * 100_000)
