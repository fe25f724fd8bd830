"""Packing, leakage and prose statistics: exact checks, brute force, held-out accuracy and the defined cases."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleanframe.llm import leakage, packing, prose, tokens

# ---- 8 --------------------------------------------------------------------------------------------------------------------------------


def test_fill_keeps_every_limit_and_little_room():
    rng = np.random.default_rng(0)
    size = np.stack([rng.integers(0, 300, 3000), np.ones(3000, int), rng.integers(0, 200, 3000)], 1)
    size[:, 2] = np.minimum(size[:, 2], size[:, 0])
    limit = np.array([1000, 12, 700])
    at = packing.fill(size, limit)
    load = np.zeros((at.max() + 1, 3))
    np.add.at(load, at, size)
    assert (at >= 0).all() and (load <= limit).all()
    least = np.ceil((size.sum(0) / limit).max())
    assert at.max() + 1 <= 1.05 * least + 1
    assert packing.fill(size[:0], limit).tolist() == []


def test_pack_places_everything_once(spark):
    r = random.Random(1)
    docs = [(i, " ".join(r.choice(["fox", "owl", "seal"]) for _ in range(r.randrange(0, 120)))) for i in range(300)]
    docs += [(900, "owl " * 5000), (901, None), (902, ""), (903, "a\n" + "b " * 70)] + docs[:20] + [(None, "x")]
    df = spark.createDataFrame(docs, "doc long, text string").withColumn("id", F.lit(1)).withColumn("block", F.lit(1)).withColumn("tokens", F.lit(1))
    for block in (40, 10_000):
        out = packing.pack(df, "doc", "text", 128, max_segments=9, block_items=block).toPandas()
        enc = tokens.encoder(tokens.RANKS)
        want = {i: len(enc.encode_ordinary(t or "")) for i, t in docs if i is not None}
        assert out.groupby("doc").tokens.sum().to_dict() == want and not out.duplicated(["doc", "piece"]).any()
        per = out.groupby("container").agg(tokens=("tokens", "sum"), n=("doc", "size"), loss=("loss", "sum"))
        assert (per.tokens <= 128).all() and (per.n <= 9).all() and (per.loss <= 128).all()
        split = out[out.pieces > 1].doc.unique()
        assert set(split) == {i for i, n in want.items() if n > 128}
        assert (out[out.doc == 900].sort_values("piece").start.diff().dropna() == 128).all()
    assert packing.pack(df.limit(0), "doc", "text").count() == 0
    tight = packing.pack(df, "doc", "text", 128, max_loss=50).toPandas()
    assert (tight.groupby("container").loss.sum() <= 50).all() and tight.groupby("doc").tokens.sum().to_dict() == want


# ---- 9 --------------------------------------------------------------------------------------------------------------------------------

ITEM = "seven amber lanterns drifted past the quiet harbour while nobody counted 417 patient herons beneath an old wooden pier at dusk tonight"
OTHER = "bold copper kettles whistled over nine frozen orchards because the careful baker forgot 88 warm loaves inside his narrow stone oven"


@pytest.mark.parametrize("text, found", [
    ("Notes. " + ITEM + " Bye.", True), (ITEM.upper().replace(" ", "  \n"), True), (" ".join(ITEM.split()[3:15]), True), (" ".join(ITEM.split()[3:14]), False),
    ("x " + ", ".join(ITEM.split()[:12]) + "!", True), ("<p>" + " <b>".join(ITEM.split()[5:18]) + "</p>", True), ("".join(c + "​" for c in ITEM[:90]), True),
    (ITEM.replace("a", "á").replace("e", "ê"), True), (" ".join(w + (" very" if i % 3 == 2 else "") for i, w in enumerate(ITEM.split())), False), ("&nbsp;".join(ITEM.split()), True),
    (" ".join(reversed(ITEM.split())), False), (" ".join(ITEM.split()[:12]).replace("seven", "oneseven"), False), ("plain words about nothing in particular " * 5, False),
])
def test_disguises(text, found):
    assert (leakage.Runs(text).longest(leakage.words(ITEM), 12) >= 12) is found


def brute_runs(docs, items):
    return {(d, i) for d, t in docs if d is not None and t for i, p in items if i is not None and p for w in [leakage.words(p)] for k in range(len(w) - 11) if leakage.Runs(t).has("".join(w[k : k + 12]))}


def test_latent_search_finds_every_run(spark):
    r = random.Random(6)
    vocab = [f"w{i}" for i in range(400)] + ITEM.split() + OTHER.split()
    items = [(1, ITEM), (2, OTHER), (3, " ".join(r.choice(vocab) for _ in range(40))), (4, "too short"), (5, None), (None, ITEM)]
    docs = []
    for d in range(150):
        w = [r.choice(vocab) for _ in range(r.randrange(0, 120))]
        if d % 4 == 0:
            src = r.choice([ITEM, OTHER, items[2][1]]).split()
            n = r.choice([11, 12, 12, 13, 20])
            s = r.randrange(0, max(1, len(src) - n + 1))
            at = r.randrange(0, len(w) + 1)
            w[at:at] = src[s : s + n]
        docs.append((d, r.choice([" ", "\n", ", "]).join(w)))
    docs += [(500, None), (501, ""), (502, "   "), (503, ("filler text " * 20_000) + ITEM), (None, ITEM), docs[4]]
    df = spark.createDataFrame(docs, "doc long, text string").withColumn("it", F.lit(1)).withColumn("ids", F.lit(1)).withColumn("item", F.lit(1))
    ev = spark.createDataFrame(items, "item long, passage string").withColumn("p", F.lit("x")).withColumn("doc", F.lit(1))
    for blocks in (2000, 1):
        out = leakage.leaks(df, "doc", "text", ev, "item", "passage", block_items=blocks)
        got = {(r["doc"], r["item"]) for r in out.where("run >= 12").collect()}
        assert got == brute_runs(docs, items) and (503, 1) in got
    assert leakage.leaks(df.limit(0), "doc", "text", ev, "item", "passage").count() == 0
    assert leakage.leaks(df, "doc", "text", ev.limit(0), "item", "passage").count() == 0
    with pytest.raises(ValueError):
        leakage.leaks(df, "doc", "text", ev, "item", "passage", stride=9)


def test_paraphrase_measures(spark):
    told = " ".join(w + (" indeed" if i % 5 == 4 else "") for i, w in enumerate(ITEM.split()))
    docs = spark.createDataFrame([(1, told), (2, "nothing of the kind here at all")], "doc long, text string")
    ev = spark.createDataFrame([(7, ITEM)], "item long, passage string")
    r = leakage.leaks(docs, "doc", "text", ev, "item", "passage", cosine=0.7).collect()
    assert len(r) == 1 and r[0]["run"] == 0 and r[0]["subsequence"] == 1.0 and r[0]["answers"] == 1.0


def test_paraphrase_beside_shared_phrasing(spark):
    """The best window stands on words copied elsewhere; the place that tells the passage counts, before or after it."""
    told = " ".join(w + (" indeed" if i % 5 == 4 else "") for i, w in enumerate(ITEM.split()))
    copied, gap = " ".join(ITEM.split()[3:12]), " filler" * 90 + " "
    texts = [copied + gap + told, told + gap + copied, gap.join([copied, told, copied]), copied]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    ev = spark.createDataFrame([(7, ITEM), (8, OTHER)], "item long, passage string")
    got = {(r["doc"], r["item"]): r for r in leakage.leaks(docs, "doc", "text", ev, "item", "passage", cosine=0.7).collect()}
    assert set(got) == {(d, 7) for d in range(4)} and all(r["cosine"] > 0.99 and r["run"] == 0 for r in got.values())
    assert all(got[d, 7]["subsequence"] == got[d, 7]["answers"] == 1.0 for d in range(3))
    assert got[3, 7]["subsequence"] == pytest.approx(9 / len(ITEM.split())) and got[3, 7]["answers"] < 1


def test_common_subsequence_equals_table():
    r = random.Random(0)
    for _ in range(40):
        a, b = [[r.choice("abcd") for _ in range(r.randrange(0, 15))] for _ in range(2)]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert leakage.common_subsequence(a, b) == t[-1][-1]


@pytest.mark.parametrize("block", [2000, 7])
def test_words_cut_by_markup_or_line_ends(spark, block):
    """Such a word in the middle of a run of twelve leaves no whole window of six at most places; both readings find it."""
    r = random.Random(4)
    names = ["".join(r.choice("bdfglmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(400)]
    items = [(i, " ".join(r.choice(names) for _ in range(30))) for i in range(20)]
    docs = []
    for i, p in items:
        ws = p.split()[4:16]
        ws[6] = ws[6][:3] + ("<b>" if i % 2 else "-\n") + ws[6][3:] + ("</b>" if i % 2 else "")
        docs.append((i, " ".join([r.choice(names) for _ in range(i % 5)] + ws + [r.choice(names) for _ in range(9)])))
    d, e = spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame(items, "i int, p string")
    got = {(x["d"], x["i"]) for x in leakage.leaks(d, "d", "t", e, "i", "p", block_items=block).where("run >= 12").collect()}
    assert got == {(i, i) for i in range(20)}


@pytest.mark.parametrize("every, recall", [(3, 0.8), (4, 0.9)])
def test_recall_and_precision_of_paraphrases(spark, every, recall):
    """Planted: every third (34 of 40 are found) or fourth word replaced by another, neighbours swapped, clauses set apart by new words; among documents of the same words."""
    r = random.Random(6)
    names = ["".join(r.choice("bcdfghklmnprstvz") + r.choice("aeiou") for _ in range(r.choice([2, 3]))) for _ in range(3000)]
    items = [(i, " ".join(r.choice(names) for _ in range(40))) for i in range(40)]
    docs, want = [(1000 + i, " ".join(r.choice(names) for _ in range(150))) for i in range(200)], set()
    for i, p in items:
        ws = [w if k % every else r.choice(names) for k, w in enumerate(p.split())]
        for k in range(0, 38, 5):
            ws[k], ws[k + 1] = ws[k + 1], ws[k]
        ws[20:20] = [r.choice(names) for _ in range(3)]
        docs.append((i, " ".join([r.choice(names) for _ in range(40)] + ws + [r.choice(names) for _ in range(60)])))
        want.add((i, i))
    d, e = spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame(items, "i int, p string")
    out = leakage.leaks(d, "d", "t", e, "i", "p", width=8, stride=4, cosine=0.55, confirm=0.45)
    got = {(x["d"], x["i"]) for x in out.where("run < 12 AND subsequence >= 0.3 AND answers >= 0.3").collect()}
    assert len(got & want) >= recall * len(want) and len(got & want) >= 0.9 * len(got), (len(got & want), len(got))


# ---- 10 --------------------------------------------------------------------------------------------------------------------------------


def test_statistics_by_hand(spark):
    rows = [(1, "The cat sat. It was 12!\n- one\n- two"), (2, ""), (3, None), (4, "  \t"), (5, "a\tb\tc\td"), (6, "x" * 300_000)]
    df = spark.createDataFrame(rows + rows[:1], "doc long, text string").withColumn("w", F.lit(1)).withColumn("flat", F.lit(1)).withColumn("t", F.lit(1)).withColumn("ln", F.lit(1))
    got = {r["doc"]: r for r in prose.statistics(df, "doc", "text").collect()}
    assert got[1]["words"] == 10 and got[1]["line_end_ratio"] == pytest.approx(1 / 3) and got[1]["list_ratio"] == pytest.approx(10 / 33)
    assert got[1]["digit_ratio"] == pytest.approx(2 / 26) and got[1]["common_ratio"] == pytest.approx(5 / 10) and got[1]["mean_word"] == 2.6
    for blank in (2, 3, 4):
        assert got[blank]["words"] == got[blank]["mean_word"] == got[blank]["table_ratio"] == 0
    assert got[5]["table_ratio"] == 1 and got[6]["longest_word"] == 300_000
    assert prose.statistics(df.limit(0), "doc", "text").count() == 0


def test_rules_hold_on_documents_kept_aside(spark):
    case = prose.RULES
    assert prose.learn(spark) == case  # what is shipped is what the learner gives
    docs = pd.DataFrame(prose.labelled(1500, 1234), columns=["no", "text", "junk"])
    seen = prose.statistics(spark.createDataFrame(docs), "no", "text").select("no", F.expr(case).alias("said")).toPandas().merge(docs, on="no")
    assert (seen.said == seen.junk).mean() >= 0.95
    hand = [("The bridge was closed, so we walked along the river and came home late in the evening.", False), ("Wir haben den Zug nicht mehr erreicht und sind dann zu Fuß nach Hause gegangen.", False),
            ("- eggs\n- milk\n- bread\n- soap\n- apples\n- rice", True), ("id,name,price\n1,fox,2.5\n2,owl,3.5\n3,seal,9.9", True), ("", True), ("   ", True), (None, True), ("%%%% #### @@@@ !!!! ^^^^", True),
            ("2021-03-01 12:00:01 WARN cache[3] miss=0x12ab t=0.5\n2021-03-01 12:00:02 INFO cache[1] hit=0x9f t=0.1", True)]
    said = {r["no"]: r["junk"] for r in prose.judge(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(hand)], "no int, text string"), "no", "text").collect()}
    assert [said[i] for i in range(len(hand))] == [w for _, w in hand]


def test_prose_of_any_language(spark):
    """None of these sentences is of the learner's grammar; the lists are in the same scripts."""
    prose_of = [
        "Вчера вечером мы сидели у окна и слушали, как идёт дождь. Бабушка рассказывала о своём детстве, а дети тихо играли на полу.",
        "昨天晚上我们坐在窗边听雨声，奶奶讲起了她小时候的故事。孩子们在地板上安静地玩耍，谁也不想去睡觉。",
        "جلسنا مساء أمس قرب النافذة نستمع إلى صوت المطر، وكانت الجدة تحكي عن طفولتها بينما كان الأطفال يلعبون بهدوء.",
        "Χθες το βράδυ καθίσαμε δίπλα στο παράθυρο και ακούγαμε τη βροχή. Η γιαγιά μιλούσε για τα παιδικά της χρόνια.",
        "Eilen illalla istuimme ikkunan ääressä ja kuuntelimme sadetta. Isoäiti kertoi lapsuudestaan, ja lapset leikkivät hiljaa lattialla.",
        "कल शाम हम खिड़की के पास बैठकर बारिश की आवाज़ सुन रहे थे। दादी अपने बचपन की कहानियाँ सुना रही थीं और बच्चे खेल रहे थे।",
        "昨日の夜、私たちは窓のそばに座って雨の音を聞いていました。祖母は子供のころの話をしてくれて、子供たちは床で静かに遊んでいました。",
        "Dün akşam pencerenin yanında oturup yağmuru dinledik. Büyükanne çocukluğunu anlattı, çocuklar da yerde sessizce oynadı.",
        "어제 저녁 우리는 창가에 앉아 빗소리를 들었다. 할머니는 어린 시절 이야기를 해 주셨고 아이들은 조용히 놀았다.",
        "Wczoraj wieczorem siedzieliśmy przy oknie i słuchaliśmy deszczu. Babcia opowiadała o swoim dzieciństwie.",
    ]
    lists = ["- молоко\n- хлеб\n- сыр\n- масло\n- яблоки\n- чай", "牛奶\n面包\n奶酪\n苹果\n茶叶\n鸡蛋", "- حليب\n- خبز\n- جبن\n- تفاح\n- شاي", "γάλα, ψωμί, τυρί, μήλα, τσάι, αυγά, λάδι, ρύζι", "1. maito\n2. leipä\n3. juusto\n4. omena\n5. tee",
             "दूध\nरोटी\nपनीर\nसेब\nचाय\nअंडे", "牛乳、パン、チーズ、りんご、お茶、卵、油、米", "süt\nekmek\npeynir\nelma\nçay\nyumurta"]
    rows = [(i, t) for i, t in enumerate(prose_of + lists)]
    said = {r["no"]: r["junk"] for r in prose.judge(spark.createDataFrame(rows, "no int, text string"), "no", "text").collect()}
    assert [said[i] for i, _ in rows] == [False] * len(prose_of) + [True] * len(lists)
    long_tag = '<div class="' + "x " * 400 + '">We met at the bridge and walked along the river. It was late.</div>'
    assert prose.statistics(spark.createDataFrame([(1, long_tag)], "no int, text string"), "no", "text").first()["words"] == 13


def test_induction_finds_a_planted_rule():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 5))
    y = ((x[:, 1] > 0.7) & (x[:, 3] < 0.5)) | (x[:, 4] > 0.9)
    rules = prose.induce(x, y)
    hit = np.any([prose.covers(r, x) for r in rules], axis=0)
    assert (hit == y).mean() > 0.97 and {f for r in rules for f, _, _ in r} == {1, 3, 4}
    assert prose.induce(x, np.zeros(2000, bool)) == []
