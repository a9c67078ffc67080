import random

from sondewerk.llm import leakage
from tests.conftest import rows

ITEM = "Which check with a borrowed geophone tells a swollen capacitor from a blocked vent when the comb blurs after ninety power dips in thaw weeks?"


def brute(docs, items, n=16):
    out = set()
    for d, t in docs:
        w = leakage.words(t or "")
        have = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i, s in items:
            v = leakage.words(s or "")
            if any(tuple(v[k : k + n]) in have for k in range(len(v) - n + 1)):
                out.add((d, i))
    return out


def test_random_passages_against_brute_force(spark):
    r = random.Random(0)
    word = lambda: r.choice("alpha beta gamma delta eins zwei drei Öl 7 x9".split())
    items = [(i, " ".join(word() for _ in range(r.choice([10, 16, 17, 30, 60])))) for i in range(30)]
    items += [(100, items[3][1]), (101, items[4][1] + " " + items[5][1])]
    docs = []
    for d in range(300):
        s = items[r.randrange(len(items))][1].split()
        a = r.randrange(len(s))
        b = a + r.choice([8, 15, 16, 17, 40])
        cut = s[a:b]
        if r.random() < 0.3 and len(cut) > 3:
            cut[r.randrange(len(cut))] = "broken"
        docs.append((d, " ".join(word() for _ in range(20)) + " " + r.choice([" ", "… ", "**", "\n- "]).join(cut) + " " + " ".join(word() for _ in range(20))))
    df, it = spark.createDataFrame([(*d, "t") for d in docs], "doc_id bigint, text string, words string"), spark.createDataFrame([(*i, 1) for i in items], "item_id bigint, text string, doc_id int")
    want = brute(docs, items)
    assert {(x.doc_id, x.item_id) for x in leakage.leaks(df, it).collect()} == want and want
    assert {(x.doc_id, x.item_id) for x in leakage.leaks(df, it, bank_chars=500).collect()} == want


def test_answers_are_in_the_automaton(spark):
    long = " ".join(f"step{i}" for i in range(20))
    items = spark.createDataFrame([(1, ITEM, "Ninety Dips"), (2, ITEM, "no"), (3, "short", long), (4, None, "alone"), (5, ITEM, None)], "item_id bigint, text string, answer string")
    docs = spark.createDataFrame([(1, ITEM + " The answer: ninety… DIPS!"), (2, ITEM), (3, "only ninety dips and no more"), (4, "x " + long.upper() + " y")], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.part): r.answer for r in leakage.leaks(docs, items, item_answer="answer").collect()}
    assert got == {(1, 1, "text"): True, (1, 2, "text"): False, (1, 5, "text"): False, (2, 1, "text"): False, (2, 2, "text"): False, (2, 5, "text"): False, (4, 3, "answer"): True}
    assert rows(leakage.leak_report(docs, items, item_answer="answer")) == [(1, 2, 1), (2, 2, 0), (3, 1, 1), (5, 2, 0)]


def test_spans_name_the_original_text(spark):
    dirty = "Intro ﬁne. " + ITEM.replace("swollen", "SWOL­LEN").replace("capacitor", "cap​acitor").replace(" vent", " ｖｅｎｔ") + " Öl für alle."
    df = spark.createDataFrame([(1, dirty), (2, None), (3, ""), (None, ITEM), (4, "…" * 50), (5, ITEM * 2000)], "doc_id bigint, text string")
    it = spark.createDataFrame([(9, ITEM), (8, None), (7, "too short"), (None, ITEM)], "item_id bigint, text string")
    got = {r.doc_id: r for r in leakage.leaks(df, it).collect()}
    assert sorted(got) == [1, 5]
    r = got[1]
    assert r.words == len(leakage.words(ITEM)) and dirty[r.start : r.end].startswith("Which check") and dirty[r.start : r.end].endswith("weeks")
    assert rows(leakage.leaks(df.limit(0), it)) == [] and rows(leakage.leaks(df, it.limit(0))) == []
    assert [dirty[a:b] for a, b in leakage.original_spans(dirty)][-2:] == ["für", "alle"]
