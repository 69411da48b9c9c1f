"""Spelt-out addresses that reach further than MARGIN from what sets the tagger off."""

from siltstone.llm import pii

LOCAL = "maria.theresia.wilhelmina.von-und-zu-hohenstein.office"
DOMAIN = "mail [dot] research [dot] department [dot] university [dot] example [dot] org"
TEXT = f"some words before {LOCAL} (at) {DOMAIN}, and more words after it"
WHOLE = (TEXT.index(LOCAL), TEXT.index(DOMAIN) + len(DOMAIN), "email")


def test_a_span_cut_at_a_margin_is_whole():
    at = TEXT.index("(at)")
    for a, b in ((at - pii.MARGIN, at + 4 + pii.MARGIN), (WHOLE[0], at + 22), (at - 9, WHOLE[1])):
        assert pii.all_spans(TEXT, [], [(a, b, "email")]) == [WHOLE]
    # pieces of one address give it once, and what follows stays out
    assert pii.all_spans(TEXT, [], [(WHOLE[0], at + 20, "email"), (at + 20, WHOLE[1], "email")]) == [WHOLE]
    plain = "write to jo.doe (at) host.com. Next one"
    assert [plain[a:b] for a, b, _ in pii.all_spans(plain, [], [(9, 24, "email"), (9, 29, "email")])] == ["jo.doe (at) host.com"]


def test_regions_hold_whole_addresses():
    (region,) = pii._regions(TEXT, pii.SEARCH, whole=True)
    assert region[0] <= WHOLE[0] and region[1] >= WHOLE[1]
    assert pii._regions("x" * 5000 + "@", pii.SEARCH, whole=True) == [(0, 5001)]
    many = "ab" * 300 + " 1 " + "c" * 200 + " 2 " + "word " * 50 + "3"
    regions = pii._regions(many, pii.SEARCH, whole=True)
    assert all(x[1] < y[0] for x, y in zip(regions, regions[1:], strict=False))


def test_masked_whole(spark):
    rows = [(k, f"some words {k} mail me.{k}@mail.example.com or +1 (555) 123-{1000 + k} now") for k in range(60)]
    tagger = pii.fit(spark.createDataFrame(rows, "doc_id long, text string"), steps=260)
    got = pii.find(spark.createDataFrame([(1, TEXT)], "doc_id long, text string"), tagger, mask=True).first()
    assert got.masked == "some words before <EMAIL>, and more words after it"
