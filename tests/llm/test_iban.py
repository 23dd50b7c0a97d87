import pytest

from occugrid.llm import pii

DE = "DE89 3704 0044 0532 0130 00"
GB = "GB82 WEST 1234 5698 7654 32"


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("IBAN BE68 5390 0754 7034 BIC KREDBEBB", ["BE68 5390 0754 7034"]),
        ("IBAN BE68 5390 0754 7034 SWIFT KREDBEBB", ["BE68 5390 0754 7034"]),
        ("to ES91 2100 0418 4502 0005 1332 AND MORE", ["ES91 2100 0418 4502 0005 1332"]),
        ("to AT61 1904 3002 3457 3201 BIC", ["AT61 1904 3002 3457 3201"]),
        (f"to {DE} BIC", [DE]),
        (f"BE68 5390 0754 7034 {GB} {DE}", ["BE68 5390 0754 7034", GB, DE]),
        (f"form AB12 {DE}", [DE]),
        ("é\U0001f600 BE68539007547034 BIC", ["BE68539007547034"]),
        ("to BE68 5390 0754 7035 BIC", []),
    ],
)
def test_words_after_an_iban(make_docs, text, wanted):
    (r,) = pii.detect(make_docs([(1, text, "s")])).collect()
    spans = [s for s in r["spans"] if s["kind"] == "iban"]
    assert [s["value"] for s in spans] == wanted
    assert [text[s["start"] : s["end"]] for s in spans] == wanted
