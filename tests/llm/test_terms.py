"""Which words reveal a value: copies, and words at the edges of a text."""

from riskloom.llm import pii

OTHERS = [(10_000 + i, f"an agent wrote a note about day {i} to another, nothing else was there") for i in range(3000)]
NOTE = "a long note on the agent kowalski, who wrote again on the {i} day of the year to k@x.example.com and to nobody else about this"


def _terms(spark, rows):
    t = spark.createDataFrame(rows, "doc_id long, text string")
    return {x.doc_id: [s.v for s in x.spans if s.k == 4] for x in pii.find_personal_data(t).collect()}


def test_copies_hide_no_term(spark):
    rows = [(i, NOTE.format(i=i)) for i in range(3)]
    copies = [(100 + i, NOTE.format(i=0)) for i in range(1000)]
    found = _terms(spark, rows + copies + OTHERS)
    assert "kowalski" in found[0] and "kowalski" in found[2] and "kowalski" in found[1099] and found[10_001] == []


def test_a_passage_in_many_texts_hides_no_term(spark):
    rows = [(i, NOTE.format(i=i)) for i in range(3)]
    pasted = [(100 + i, f"{'x ' * 60}{NOTE.format(i=0)}{' y' * 60} own end {i}") for i in range(300)]
    found = _terms(spark, rows + pasted + OTHERS)
    assert "kowalski" in found[1] and "kowalski" in found[399]


def test_texts_are_counted_once_by_either_way(spark):
    t = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None), (6, "")], "doc_id long, text string")
    for most in (0, 100):
        texts, n = pii._distinct_texts(t, most)
        assert n == 4 and sorted(map(repr, (r.text for r in texts.collect()))) == sorted(map(repr, ["a", "b", None, ""]))


def test_whole_words_at_the_edges(spark):
    """Names at the start and end of texts, right at the window's edge, and one that the edge cuts in two."""
    rows = [(i, f"Kowalski, a@x.example.com {i}") for i in range(4)]
    rows += [(10 + i, f"{i} b@x.example.com heronblue") for i in range(4)]
    rows += [(20 + i, f"{i}{'.' * 100} edgeword {'=' * 91}c@x.example.com {i}") for i in range(4)]
    rows += [(30 + i, f"{i}{'.' * 100} cutword {'=' * 93}d@x.example.com {i}") for i in range(4)]
    rows += [(40 + i, f"{i} e@x.example.com {'=' * 91}lastword. {i}{'.' * 100}") for i in range(4)]
    rows += [(50 + i, f"{i} f@x.example.com {'=' * 92}cuttails. {i}{'.' * 100}") for i in range(4)]
    found = _terms(spark, rows + OTHERS)
    assert (found[0], found[10], found[20], found[30], found[40], found[50]) == (["Kowalski"], ["heronblue"], ["edgeword"], [], ["lastword"], [])
