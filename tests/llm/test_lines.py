from helpers import A, B, docs
from strata.llm.lines import cut, remove_repeats, removable, units

P = "This passage of many words is found in several documents of the corpus. It goes on for a second sentence with ten more words or so. And it ends with a third one that nobody would write twice."


def test_removal(spark):
    texts = [f"{A}\n{P}", f"{B}\n{P}\nend", f"Own words lead into it here now. {P} And own words follow it here too.", None, "", "Les.\nLes.",
             f"  {P.upper()}  ", P]
    out = {r["doc_id"]: r for r in remove_repeats(docs(spark, *texts).withColumnRenamed("lang", "removed")).collect()}
    assert out[0]["text"] == texts[0] and not out[0]["removed"]
    assert out[1]["text"] == f"{B}\nend"
    assert out[2]["text"] == "Own words lead into it here now. And own words follow it here too."
    assert out[3]["text"] is None and out[4]["text"] == "" and out[5]["text"] == texts[5]
    assert out[6]["text"] == out[7]["text"] == ""
    for r in out.values():
        for s in r["removed"]:
            assert "passage" in texts[r["doc_id"]][s["start"]:s["end"]].lower()


def test_ranks_and_repeated_rows(spark):
    rows = remove_repeats(docs(spark, P, P, P, ids=[None, 3, 3])).collect()
    assert [(r["doc_id"], r["text"]) for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["text"]))] == [(3, P), (3, P), (None, "")]
    assert remove_repeats(docs(spark)).count() == 0


def test_matches_brute_force(spark):
    sentences = [f"Sentence number {i} has a few words of its own here." for i in range(12)]
    texts = [" ".join(sentences[(7 * i + k) % 12] for k in range(5)) + ("\n" if i % 2 else " ") + sentences[i % 3] for i in range(30)]
    first = {}
    for i, t in enumerate(texts):
        for u in sorted(units(t), key=lambda u: (u[2], u[0])):
            first.setdefault(u[5], (i, u[2]))
    want = [cut(t, removable([u[:5] for u in units(t) if first[u[5]] != (i, u[2])])) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["text"] for r in remove_repeats(docs(spark, *texts)).collect()}
    assert [got[i] for i in range(30)] == want


def test_long_text():
    text = "word " * 200_000
    assert len(units(text)) == 2
    assert cut("a\nb\nc", [(2, 3)]) == "a\nc" and cut("a\nb", [(2, 3)]) == "a" and cut("ab", [(0, 2)]) == ""
