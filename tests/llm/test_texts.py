"""Problems 6 to 8 against brute force, with null, empty, long and repeated texts."""

import numpy as np
import pytest

pytest.importorskip("varve.llm")

from varve.llm import leaks, packing, spam  # noqa: E402
from varve.llm.words import words  # noqa: E402

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def _packed(spark, sizes, capacity=100):
    df = spark.createDataFrame(sizes, "doc_id bigint, size bigint, piece string")
    rows = packing.pack(df, capacity).collect()
    bins = {}
    for r in rows:
        if r.container_id is not None:
            bins.setdefault(r.container_id, []).append(r.n_tokens)
    assert all(sum(b) <= capacity for b in bins.values())
    for doc, size, _ in sizes:
        own = sorted((r.piece, r.n_tokens) for r in rows if r.doc_id == doc)
        assert [p for p, _ in own] == list(range(len(own))) and sum(n for _, n in own) == (size or 0)
        assert len(own) == 1 or (size > capacity and all(n == capacity for _, n in own[:-1]))
    return bins


def test_packing_leaves_little_space(spark):
    rng = np.random.default_rng(1)
    sizes = [(i, int(v), "") for i, v in enumerate(np.clip(rng.lognormal(2.3, 0.8, 3000), 1, 95))] + [(5000, 1234, ""), (5001, 200, ""), (5002, 0, ""), (5003, None, ""), (5004, 100, "")]
    bins = _packed(spark, sizes)
    total = sum(s or 0 for _, s, _ in sizes)
    assert len(bins) <= -(-total // 100) * 1.01
    assert _packed(spark, []) == {} and len(_packed(spark, [(1, 60, ""), (2, 60, ""), (3, 40, "")])) == 2


def test_awkward_sizes_are_not_split(spark):
    bins = _packed(spark, [(i, 51, "") for i in range(150)])
    assert len(bins) == 150


def test_exchanges_raise_squared_fill():
    bins = [[(i, 0, s) for s in sizes] for i, sizes in enumerate(([60, 30], [50, 20], [45, 10], [35, 35]))]
    before = sum(sum(x[2] for x in b) ** 2 for b in bins)
    after = packing._improve(bins, 100)
    assert sum(sum(x[2] for x in b) ** 2 for b in after) > before and len(after) == 3
    assert packing._exchange([(0, 0, 30), (1, 0, 20)], [(2, 0, 45)], 5, 1)[0] == 5
    many = [(i, 0, 1) for i in range(900)] + [(999, 0, 20)]
    assert packing._exchange(many, [(2, 0, 19)], 2, 1) == (2, (0, 900), (0,)) and packing._exchange([(2, 0, 19)], many, 17, 17) == (17, (0,), (0, 1))


def test_tokens_of_whole_texts(spark):
    df = spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (4, "word " * 20000), (5, "<|endoftext|>")], "doc_id bigint, text string")
    got = {r.doc_id: r["size"] for r in packing.token_counts(df, VOCABULARY).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] >= 20000 and got[5] > 1


def test_words_as_a_reader_sees_them():
    assert words("The <b>qu</b>ick&nbsp;&amp; café") == ["the", "qu", "ick", "café"]
    assert words("Ｔｈｅ so­ft​ly café") == ["the", "softly", "café"]
    assert words("> > one\r\n> | two\n[quote=x]three[/quote]<!-- four -->") == ["one", "two", "three"]
    assert words(None) == words("") == words("?!") == []


def _leaks(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id bigint")
    i = spark.createDataFrame(items, "item_id bigint, text string, doc_id bigint")
    return {(r.doc_id, r.item_id): r for r in leaks.leaks(d, i).collect()}


def test_every_run_of_twelve_words_is_found(spark):
    rng = np.random.default_rng(2)
    lexicon = [f"w{i}" for i in range(60)]
    opening = "answer the question below in one short sentence please and".split()
    items = {i: opening + list(rng.choice(lexicon, 30)) for i in range(12)} | {50: ["short", "one"]}
    items[12] = items[3][:25] + list(rng.choice(lexicon, 10))
    docs = {}
    for d in range(150):
        text = list(rng.choice(lexicon, 40))
        if d % 2:
            i, n = int(rng.integers(13)), int(rng.integers(8, 16))
            at = int(rng.integers(0, len(items[i]) - n))
            text[20:20] = items[i][at : at + n]
        docs[d] = text
    docs[200] = list(rng.choice(lexicon, 30000)) + items[5][5:20]
    docs[201] = docs[200][-20:]
    got = _leaks(spark, [(d, " ".join(t), 0) for d, t in docs.items()] + [(900, None, 0), (901, "", 0)], [(i, " ".join(t), 0) for i, t in items.items()] + [(60, None, 0)])
    runs = {i: {tuple(t[k : k + 12]) for k in range(len(t) - 11)} for i, t in items.items()}
    want = {(d, i) for d, t in docs.items() for k in range(len(t) - 11) for i in runs if tuple(t[k : k + 12]) in runs[i]}
    assert {k for k, r in got.items() if r.run >= 12} == want and want
    assert _leaks(spark, [], [(1, "a", 0)]) == {} and _leaks(spark, [(1, "a", 0)], []) == {}


def test_edited_copies_score(spark):
    item = [f"t{i}" for i in range(40)]
    edited = item[:10] + ["x"] + item[10:19] + item[21:30]
    got = _leaks(spark, [(1, " ".join(edited), 0)], [(1, " ".join(item), 0)])
    assert got[1, 1].run == 10 and got[1, 1].score == 2 * 28 - 1 - 2


def test_recall_of_edited_copies(spark):
    rng = np.random.default_rng(6)
    lexicon = [f"v{i}" for i in range(3000)]
    items = [list(rng.choice(lexicon, 40)) for _ in range(100)]
    docs, planted = [], {}
    for k, share in enumerate((0.05, 0.1, 0.15, 0.2)):
        for i, item in enumerate(items):
            copy = [str(rng.choice(lexicon)) if rng.random() < share else w for w in item]
            docs.append((1000 * k + i, " ".join([*rng.choice(lexicon, 30), *copy, *rng.choice(lexicon, 30)]), 0))
            planted.setdefault(share, []).append((1000 * k + i, i))
    got = _leaks(spark, docs, [(i, " ".join(item), 0) for i, item in enumerate(items)])
    found = {share: sum(pair in got and got[pair].score >= 2 * leaks.PASSAGE for pair in pairs) for share, pairs in planted.items()}
    assert found[0.05] == 100 and found[0.1] >= 99 and found[0.15] >= 97 and found[0.2] >= 90


def test_edited_copy_beside_a_verbatim_one(spark):
    item = [f"t{i}" for i in range(40)]
    edited = [f"x{i}" if i % 11 == 5 else w for i, w in enumerate(item)]
    got = _leaks(spark, [(1, " ".join(item), 0), (2, " ".join(edited), 0)], [(1, " ".join(item), 0)])
    assert got[1, 1].run == 40 and got[2, 1].run == 10 and got[2, 1].score == 2 * 36 - 4


def test_documents_aligned_together_score_as_alone():
    rng = np.random.default_rng(4)
    documents = [rng.integers(0, 4, n).astype(np.uint64) for n in (15, 0, 3, 20, 1, 15)]
    item = rng.integers(0, 4, 12).astype(np.uint64)
    best, longest = leaks.align_all(documents, item)
    assert [(int(s), int(r)) for s, r in zip(best, longest, strict=True)] == [leaks.align(d, item) for d in documents]


def test_alignment_matches_the_plain_recurrence():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = rng.integers(0, 4, 15).astype(np.uint64), rng.integers(0, 4, 12).astype(np.uint64)
        h = np.zeros((13, 16), int)
        for i in range(1, 13):
            for j in range(1, 16):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if b[i - 1] == a[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert leaks.align(a, b)[0] == h.max()


PROSE = "The second pump of the lab was replaced by a quiet student from the group. We plan to close the folder as soon as the branch is final. Nobody in our office checked the index after the meeting. "
LIST = "cheap boots, buy boots, boots online, best boots, discount boots, order boots, boots shop, free boots, boots sale, outlet boots"
LINKS = "\n".join(f"{i}. sale tent - http://shop{i}.example/p/{i}" for i in range(1, 10))


def test_stuffed_pages(spark):
    table = "\n".join("\t".join(f"{i}.{j}" for j in range(5)) for i in range(20))
    cases = {
        1: LIST, 2: LINKS, 3: PROSE.split(".")[0] + ".\n" + LIST * 2, 4: " | ".join(f"lamp{c} tent red" for c in "abcdefgh"), 5: "#buyboots #saleboots #bestboots #topboots #newboots #freeboots #boots",
        6: "[quote=x]" + LIST + "[/quote]\n" + "\n".join(f'<a href="http://a{i}.example/x">cheap tent</a>' for i in range(8)), 7: "BUY B00T5 CH34P B00TS S4L3 D34L B00TS 0FF3R NEW B00TS FR33 SHIPPING B00TS S4L3 CH34P B00TS D34L N3W SALE FR33 B00TS BUY CH34P N3W B00TS",
    }
    fine = {
        20: PROSE, 21: PROSE + table, 22: PROSE * 4 + LINKS[:80], 23: "thanks", 24: PROSE + "\n-- \n" + LIST, 25: PROSE + "\n> " + LIST + "\n> " + LIST, 26: "<blockquote>" + LIST * 3 + "</blockquote>" + PROSE, 27: None, 28: "", 29: table,
        30: "We used Nfx23, Kcz41, Ray77, Cey48, Cbx62, Hdy29, Kcz78 as markers. " + PROSE, 31: "boots, tent, lamp", 32: "\n".join(f"[0{i}:1{i}] step={i} loss=0.{i} ok" for i in range(9)),
    }
    rows = [(d, t, 0) for d, t in (cases | fine).items()] + [(100 + i, PROSE * (i % 5 + 1), 0) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, entries int")
    assert {r.doc_id for r in spam.stuffed(df).collect()} == set(cases)
    assert spam.stuffed(df.limit(0)).count() == 0


def test_the_model_decides(spark, monkeypatch):
    rng = np.random.default_rng(5)
    mixed = "the and pump lab of was a quickly group student we plan as office after meeting nobody checked index close folder final soon is in branch the replaced our from to quiet. "
    rows = [(1, LIST, 0), (2, mixed * 3, 0)] + [(100 + i, PROSE * (i % 5 + 1), 0) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, mix int")
    found = {r.doc_id: r for r in spam.scored(df).collect()}
    assert found[1].odd == found[2].odd == 1 and found[101].odd < 0.5 and found[101].normal
    assert not found[1].normal and found[2].normal  # words in disorder are not keywords
    assert {r.doc_id for r in spam.stuffed(df).collect()} == {1}
    lists = [(300 + i, ", ".join(" ".join(["boots"] * int(n)) for n in rng.integers(1, 5, 6 + i % 5)), 0) for i in range(60)]
    df = spark.createDataFrame(rows + lists, "doc_id bigint, text string, mix int")
    assert {1} | {d for d, *_ in lists} <= {r.doc_id for r in spam.stuffed(df).collect()} | {d for d, t, _ in lists if t.count(",") < 5}
    monkeypatch.setattr(spam, "_prose", spam.symbols)  # a model that has learnt lists takes them for normal
    assert spam.stuffed(df).where("doc_id = 1").count() == 0


def test_n_grams_seen_once_count(spark):
    df = spark.createDataFrame([("The pump of the lab was replaced by 7 students.",)], "own string")
    counts = spam.prose_model(df)
    assert counts["D"] == 2 and counts["DwPDw"] == 1 and counts["VwP0w"] == 1


def test_own_text_of_nested_quotes():
    text = "On 2020-01-01, x wrote:\n> a\n>> b\n| c\nmine &amp; [quote=y]q [quote=z]r[/quote] s[/quote] too\n--\nsig"
    assert spam.own_text(text).split() == ["mine", "&", "too"]
    assert spam.own_text("-- \nonly a signature") .split()[-1] == "signature"


def test_own_text_ends_at_a_signature_below_a_rule():
    assert spam.own_text("mine, all<hr><i>A slanted signature.</i>\n").split() == ["mine,", "all"]
    assert spam.own_text("first<hr>then <i>slanted</i> and on").split() == ["first", "then", "slanted", "and", "on"]
    assert spam.own_text("<hr><i>nothing else</i>").split() == ["nothing", "else"]


def test_dividers_part_the_text_and_end_nothing():
    blocks = ["cheap lamps, new lamps, best lamps", "red shoes, blue shoes, low price", "phone case, glass case, sale"]
    text = "\n_____\n".join(blocks)
    assert "red shoes" in spam.own_text(text) and "glass" not in spam.own_text(text)
    long = "head\n--\n" + "one word after another " * 20
    assert spam.own_text(long).split().count("word") == 20
    assert spam.own_text("mine\n-- \nmy name\n--\n").split() == ["mine"]
