"""Operators of the subpackage against brute force, round trips and held-out cases."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm.p1_nearcopies import BANDS, RADIUS, ROWS, BKTree, _signatures, near_copies
from palimpsest.llm.p3_cutoff import add_batch, build_tree, coded, cutoffs
from palimpsest.llm.p4_split import cuts
from palimpsest.llm.p6_pairs import CUTOFF, DEFECTS, fit_label_model, votes
from palimpsest.llm.p7_leaks import leaks
from palimpsest.llm.p8_encode import VOCAB_PATH, Encoder, pretokens
from palimpsest.llm.p9_pack import Packer
from palimpsest.llm.p10_mojibake import Repairer


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n\r", max_size=400), st.integers(20, 60))
def test_cuts_cover_the_text(text, limit):
    c = cuts(text, limit, 5, 8)
    if not text:
        assert c == []
        return
    assert c[0][0] == 0 and c[-1][1] == len(text)
    for (a, b, _), (x, y, _) in zip(c, c[1:], strict=False):
        assert b - a <= limit and a < x and b - 8 <= x <= b < y
    assert all(b - a <= limit for a, b, _ in c)


def test_cuts_without_any_boundary():
    c = cuts("x" * 20_000)
    assert [b - a for a, b, _ in c[:-1]] == [6000] * (len(c) - 1)
    assert all(b - x == 200 for (_, b, _), (x, _, _) in zip(c, c[1:], strict=False))


def test_bk_tree_finds_all_within_the_radius():
    r = random.Random(3)
    base = [r.getrandbits(128) for _ in range(20)]
    fps = [b ^ (1 << r.randrange(128)) ^ (1 << r.randrange(128)) for b in base for _ in range(5)]
    tree = BKTree()
    for i, f in enumerate(fps):
        tree.add(f, i)
    for f in fps[:30]:
        assert sorted(tree.within(f, 30)) == [i for i, g in enumerate(fps) if (f ^ g).bit_count() <= 30]


def test_pairs_at_the_threshold_meet():
    """Of pairs of similarity exactly 0.6 (75 of 125 shingles), 0.995 at least share a band within the radius."""
    r, pairs = np.random.default_rng(7), 4000
    both = r.integers(0, 2**63, (pairs, 125), dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, (pairs, 125), dtype=np.uint64)
    h = np.stack([both[:, :100], both[:, 25:]], 1).ravel()
    values, sim = _signatures(h, np.full(2 * pairs, 100), BANDS, ROWS)
    meet = (values[::2] == values[1::2]).any(1) & (np.bitwise_count(sim[::2] ^ sim[1::2]).sum(1) <= RADIUS)
    assert meet.mean() >= 0.995


@pytest.mark.parametrize("block", [4, 2048])
def test_near_copies_against_brute_force(spark, block):
    """Also with shards cut into blocks, as for a group that holds most of the rows."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows, texts = [], {}
    for i in range(60):
        w = [r.choice(words) for _ in range(80)]
        for k in range(r.choice([1, 1, 2, 14 if i == 0 else 3])):
            v = list(w)
            for _ in range(r.randrange(0, 8)):
                v[r.randrange(80)] = r.choice(words)
            texts[len(rows)] = v
            rows.append((len(rows), " ".join(v)))
    pairs, members = near_copies(spark.createDataFrame(rows, "rec_id long, text string"), "rec_id", block=block)
    rep = {m.id: m.rep for m in members.collect()}
    tri = {i: set(zip(v, v[1:], v[2:], strict=False)) for i, v in texts.items()}
    want = {
        (a, b) for a in tri for b in tri if a < b and rep[a] == a and rep[b] == b
        and len(tri[a] & tri[b]) >= 0.6 * len(tri[a] | tri[b])
    }
    got = {(p.a, p.b) for p in pairs.collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 20


def test_trees_of_batches_add_up_to_the_whole(spark):
    r = random.Random(1)
    rows = [(i, r.choice("ab"), r.choice([r.gauss(0, 1e3), round(r.random(), 1), float("inf"), float("-inf"), 5e-324])) for i in range(400)]
    df = spark.createDataFrame(rows, "rec_id long, source string, score double")
    all_, parts = coded(df, "rec_id"), [coded(df.filter(f"rec_id % 3 = {k}"), "rec_id") for k in range(3)]
    tree = add_batch(add_batch(build_tree(parts[0]), build_tree(parts[1])), build_tree(parts[2]))
    assert sorted(map(tuple, tree.collect())) == sorted(map(tuple, build_tree(all_).collect()))
    c = cutoffs(all_, tree, spark.createDataFrame([("a", 37), ("b", 100)], "source string, keep_pct int"))
    for x in c.collect():
        s = sorted((v for _, src, v in rows if src == x.src), reverse=True)
        k = -(-len(s) * x.pct // 100)
        assert (x.k, x.cutoff) == (k, s[k - 1])


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_pretokens_and_ids_round_trip(text):
    kept = test_pretokens_and_ids_round_trip.__dict__
    if "enc" not in kept:
        kept["enc"] = Encoder(open(VOCAB_PATH, "rb").read())
        kept["back"] = {r: t for t, r in kept["enc"].ranks.items()}
    enc, back = kept["enc"], kept["back"]
    assert "".join(pretokens(text)) == text
    flat, n = enc.encode([text, None, ""])
    assert n.tolist() == [len(flat), 0, 0]
    assert b"".join(back[i] for i in flat.tolist()).decode() == text


def test_packing_wastes_little_and_overfills_nothing():
    r = np.random.default_rng(2)
    sizes = np.minimum(2048, r.lognormal(6, 1, 5000).astype(int) + 1)
    p, fill = Packer(), {}
    for s in sizes.tolist():
        b, at = p.put(s)
        assert at == fill.get(b, 0)
        fill[b] = at + s
    assert max(fill.values()) <= 2048 and len(fill) <= 1.05 * sizes.sum() / 2048 + 64


PAGES = ["cp1252", "cp1250", "cp1251", "cp437", "mac_roman", "latin-1"]


@pytest.mark.parametrize("page", PAGES)
def test_garbling_comes_back(page):
    from palimpsest.llm.p10_mojibake import _read

    text = "« Le château », dit l’élève à demi-voix — “déjà?” Ñandú, größer, £5."
    r = Repairer()
    assert r.repair(text) == (text, 0, [])
    once = _read(text.encode(), page)
    assert r.repair(once)[0] == text and r.repair("Right: déjà vu.\n" + once)[0] == "Right: déjà vu.\n" + text


def test_double_garbling_and_losses():
    r = Repairer()
    twice = "l’été".encode().decode("cp1252").encode().decode("cp1252")
    assert r.repair(twice)[0] == "l’été"
    assert r.repair("caf�")[1] == 1
    for sound in ("TRÈS ÂGÉ, À L’AUBE", "He wrote Ã and Â in the margin.", "35°, 5½, ± ¼", "¿SEÑOR ENSEÑÓ?", "λόγος", "÷¶§¤×¬"):
        assert r.repair(sound) == (sound, 0, [])


def test_right_letters_beside_byte_mistakes_stay():
    r = Repairer()
    line = "También el camino débil, y compró el baúl. Él heredÛ lo que perdiÛ el tÌmido niÒo, señor."
    assert r.repair(line)[0] == "También el camino débil, y compró el baúl. Él heredó lo que perdió el tímido niño, señor."
    # a word with a match comes back whole, and so do words between two such words
    whole = "Le cÈlËbre prÈcepteur mangea; ìThe crypt,î said the uncleís friend, the protÈgÈ of Garfieldóthe fÍte"
    assert r.repair(whole)[0] == "Le célèbre précepteur mangea; “The crypt,” said the uncle’s friend, the protégé of Garfield—the fête"


LABELLED = [
    ("Who was the father of Kel?", "TBD", "empty"), ("Who was the father of Kel?", "Osby.", None), ("Who was the father of Kel?", None, "empty"),
    ("Set down the verse Ruel 2:5.", "Set down the verse Ruel 2:5.", "echo"), ("Say after me, word for word: The old mill stood.", "The old mill stood.", None),
    ("What doth it teach?", "I’m sorry. I must decline to help you here.", "refusal"),
    ("What doth it teach?", "The widow said, 'I must decline thy gift.' And she went up to the gate.", None),
    ("What doth it teach?", "I am unable to praise patience too highly, for here the elders wept.", None),
    ("What doth the book teach?", "Der alte König suchte ein Schloss und der Garten war nicht für sein Volk.", "other_language"),
    ("Render into German: the old king.", "Der alte König suchte ein Schloss und der Garten war nicht für sein Volk.", None),
    ("Name the three lessons of Ruel.", "It teacheth three things: first, the captain crossed the", "truncated"),
    ("How many sons are reckoned in Ruel 6?", "seven", None), ("Where is it written, 'Then the widow'?", "Ruel 6:3", None),
]


def test_label_model_on_labelled_pairs():
    """The cutoffs hold on labelled pairs when the model is fitted to their votes alone."""
    seen = [votes(q, a, None) for q, a, _ in LABELLED]
    model = {d: fit_label_model({p: sum(tuple(v[d]) == p for v in seen) * 100 for p in {tuple(v[d]) for v in seen}}) for d in DEFECTS}
    for (_, _, want), v in zip(LABELLED, seen, strict=True):
        got = [d for d in DEFECTS if model[d][tuple(v[d])] >= CUTOFF[d]]
        assert got[:1] == ([want] if want else [])


def test_edited_items_are_found(spark):
    """Items of 15 words with the middle one replaced: no eight words in a row, similarity 26 of 32."""
    r = random.Random(11)
    items = [(i, [f"w{i}x{k}" for k in range(15)]) for i in range(60)]
    docs = [(i, " ".join(["so", *w[:7], r.choice("abc"), *w[8:], "then"])) for i, w in items]
    d = spark.createDataFrame(docs, "rec_id long, text string")
    q = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, query string")
    assert leaks(d, "rec_id", q, "item_id").count() == 0
    got = leaks(d, "rec_id", q, "item_id", least=0.8).collect()
    assert all(x.rec_id == x.item_id and abs(x.similarity - 26 / 32) < 1e-9 for x in got) and len(got) >= 59


def test_edited_windows_are_similar(spark):
    docs = spark.createDataFrame([(1, "so a b c d e f g h then"), (2, "so a b c d x e f g h"), (3, None)], "rec_id long, text string")
    items = spark.createDataFrame([(7, "A b, c D e f g h"), (8, None)], "item_id long, query string")
    assert [tuple(r) for r in leaks(docs, "rec_id", items, "item_id").collect()] == [(1, 7, 1.0)]


def test_garbled_again_and_again():
    """Six readings in a wrong page, two single-byte mistakes in one text, and letters in quoting marks."""
    from palimpsest.llm.p10_mojibake import _read

    r, text = Repairer(), "l’été à Œuvre, dit l’élève — ψυχή"
    again = text
    for _ in range(6):
        again = _read(again.encode(), "cp1252")
        assert r.repair(again)[0] == text
    assert r.repair("Il a mangÈ le thé au cafÈ.")[0] == "Il a mangé le thé au café."
    two = r.repair("Il a mangÈ au cafÈ.\nElle a mangй au cafй.")
    assert two[0] == "Il a mangé au café.\nElle a mangé au café." and two[2] == ["cp1252>cp1251", "cp1252>mac_roman"]
    assert r.repair("La lettre «Â» et la lettre «Ã».") == ("La lettre «Â» et la lettre «Ã».", 0, [])


@pytest.mark.parametrize("size", [1, 7, 60, 100, 300])
def test_a_phrase_over_and_over_is_seen_at_any_length(size):
    from palimpsest.llm.p2_quality import Lines

    phrase = [f"w{i}" for i in range(size)]
    per = [phrase * 3 for _ in range(10)]
    assert Lines._repeats(per).all()
    prose = [[f"a{i}", "in", "the", "year", "of", "the", f"b{i}"] for i in range(60)]
    assert not Lines._repeats(prose).any()


def test_a_vocabulary_is_refused_rather_than_cut(spark, monkeypatch):
    from palimpsest.llm import p2_quality as Q

    v = spark.createDataFrame([("kettle", 5), ("été", 3), ("rare", 2), ("__total__", 10), (None, 4)], "word string, cnt long")
    known = Q.known_words(v)
    assert "kettle" in known and "été" in known and "rare" not in known and "__total__" not in known
    monkeypatch.setattr(Q, "MAX_VOCAB", 1)
    with pytest.raises(ValueError):
        Q.known_words(v)


def test_training_moves_labels_and_unseen_kinds_are_seen(spark):
    """Kinds of lists and tables that no pattern names; the trained tables differ from the first ones."""
    from palimpsest.llm import p2_quality as Q

    r, some = random.Random(2), "the miller stood beside an old gate and counted his sheep while widow sang of winter".split()
    lines = Q.Lines(frozenset(some))
    prose = "\n".join(" ".join(r.choices(some, k=12)).capitalize() + "." for _ in range(12))
    figures = "\n".join(f"{k * 37 % 91} {k * 11 % 17} {k * 53 % 29}" for k in range(30))
    junk = "\n".join("xq" + "zvkw"[k % 4] * 3 + " bcdfg plmk wrtz" for k in range(30))
    start, obs = Q.start_model(), [lines.observe([t])[0][0] for t in (prose, figures, junk)]
    trained = start.trained(obs * 40, 100.0)
    assert any(np.abs(np.exp(a) - np.exp(b)).max() > 0.05 for a, b in zip(start.emit, trained.emit, strict=True))
    for model in (start, trained):
        odd = [by[1:].sum() > 0.5 for by in Q.odd_shares(model, obs, [np.ones(len(o)) for o in obs])]
        assert odd == [False, True, True]


def test_long_runs_are_encoded_like_short_ones():
    """Pre-tokens without a break: equal to tiktoken, and 200,000 letters in seconds."""
    import time

    import tiktoken

    from palimpsest.llm.p8_encode import LONG, SPLIT_PATTERN

    enc = Encoder(open(VOCAB_PATH, "rb").read())
    ref = tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=enc.ranks, special_tokens={})
    r = random.Random(8)
    for n, letters in ((LONG - 1, "abcdef"), (LONG, "aab"), (LONG + 1, "abcdefghijklmnopqrstuvwxyz"), (5000, "a"), (20_000, "etaoinshr"), (3000, "éà中")):
        t = "".join(r.choices(letters, k=n))
        assert enc.encode([t])[0].tolist() == ref.encode_ordinary(t)
    t = "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=200_000))
    at = time.time()
    ids = enc.encode([t])[0].tolist()
    assert time.time() - at < 20
    back = {v: k for k, v in enc.ranks.items()}
    assert b"".join(back[i] for i in ids) == t.encode()


@pytest.mark.parametrize("least", [1.0, 0.8])
def test_blocks_of_items_share_scans(spark, monkeypatch, least):
    from palimpsest.llm import p7_leaks as L

    r = random.Random(12)
    items = [(i, [f"w{i}x{k}" for k in range(12)]) for i in range(20)]
    docs = [(i, " ".join(["so", *w[2:11], "then", *items[(i + 7) % 20][1]])) for i, w in items] + [(99, None), (98, "")]
    d = spark.createDataFrame(docs, "rec_id long, text string")
    q = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(77, None)], "item_id long, query string")
    want = sorted(tuple(x) for x in leaks(d, "rec_id", q, "item_id", least=least).collect())
    assert {(a, b) for a, b, _ in want} >= {(i, j) for i in range(20) for j in (i, (i + 7) % 20)} and r
    for name, n in (("ITEM_BLOCK", 30), ("NEAR_BLOCK", 60), ("SCAN_BLOCKS", 3)):
        monkeypatch.setattr(L, name, n)
    assert sorted(tuple(x) for x in leaks(d, "rec_id", q, "item_id", least=least).collect()) == want


def test_labels_of_many_sequences_are_those_of_each():
    from palimpsest.llm.hmm import LineHmm

    r = np.random.default_rng(4)
    model = LineHmm([r.random((4, 5)), r.random((4, 3))], r.random((4, 4)))
    some = [np.stack([r.integers(0, 5, n), r.integers(0, 3, n)], 1).astype(np.int8) for n in (0, 1, 9, 3, 40, 1, 0, 9)]
    for a, b in zip(model.label_all(some), map(model.label, some), strict=True):
        assert a.tolist() == b.tolist()
    assert model.label_all([]) == []


def scans(words):
    from palimpsest.llm.p5_scans import Scans

    return Scans(frozenset(words), frozenset(w[:k] for w in words for k in range(1, len(w) + 1)))


def test_readings_of_misread_tokens():
    s = scans(["millillilli", "modern", "dock", "the", "burn", "bum", "still"])
    assert s.unsigned("mi11i11i11i") == "millillilli" and s.unsigned("m|||i|||i|||i") is None
    assert s.unsigned("mi||i||i||i") == "millillilli" and s.unsigned("sti11") == "still"
    assert s.meant("rnodern") == "modern"
    assert s.meant("clock") == "dock" and s.meant("burn") is None and s.meant("xyz") is None
    assert s.unsigned("1|" * 300 + "a") is None


@pytest.mark.parametrize("letters", [5, 60, 61, 400])
def test_broken_words_of_any_length(letters):
    from palimpsest.llm.p5_scans import broken_end

    s = scans(["well-known"])
    assert broken_end("so " + "a" * letters + "- ") == "a" * letters and broken_end("so -") is None and broken_end("") is None
    assert s.joins("a" * letters, "  " + "b" * letters + " c") == ""
    assert s.joins("well", "known man") == "-" and s.joins(None, "x") is None and s.joins("Anne", "Marie") is None


@pytest.mark.parametrize("pad", [3, 200])
def test_page_marks_of_any_length(pad):
    from palimpsest.llm.p5_scans import page_mark

    assert page_mark("BOOK " + "X" * pad + ".   xxvi") and page_mark("12   THE " + "LIFE " * pad) and page_mark("- page 12 -") and page_mark("[ 7 ]")
    assert not page_mark("the " * pad + "end   12") and not page_mark("He counted   12") and not page_mark("- and so -")


def test_labels_decide_what_is_joined():
    """Prose goes on across a gap and a header; verse keeps its lines; all texts are decoded."""
    from palimpsest.llm import p5_scans as P

    s, m = scans(["harbour"]), P.start_model()
    text = (
        "The captain of the har-\nbour praised the kettle, and the miller who stood beside the\nriver counted\n\n"
        "THE LIFE OF MUSLIN   xxvi\n\nthe sheep of his neighbour before the harvest began.\n\n"
        "The widow sang of winter,\nAnd the shepherd heard her song,\nAnd the river ran to harbour,\nAnd the night was long."
    ).split("\n")
    obs, wrong = s.observe(text)
    labels = m.label_all([obs])[0]
    assert s.evidence(obs, labels, wrong, text) == (1, 0, 1)
    assert s.repair(text, labels).split("\n\n") == [
        "The captain of the harbour praised the kettle, and the miller who stood beside the river counted the sheep of his neighbour before the harvest began.",
        "The widow sang of winter,\nAnd the shepherd heard her song,\nAnd the river ran to harbour,\nAnd the night was long.",
    ]


@pytest.mark.parametrize("most", [1 << 26, 1 << 10])
def test_filter_of_candidates_or_semi_join(spark, monkeypatch, most):
    """The filter grows with the ids; above its bound the texts are semi-joined, and the pairs are the same."""
    from palimpsest.llm import p1_nearcopies as N

    monkeypatch.setattr(N, "BLOOM_MOST", most)
    r = random.Random(6)
    base = [[f"w{r.randrange(400)}" for _ in range(60)] for _ in range(40)]
    rows = [(i * 2 + k, " ".join(w if not k or j != 30 else "x" for j, w in enumerate(b))) for i, b in enumerate(base) for k in (0, 1)]
    pairs, _ = near_copies(spark.createDataFrame(rows, "rec_id long, text string"), "rec_id")
    assert sorted((p.a, p.b) for p in pairs.collect()) == [(2 * i, 2 * i + 1) for i in range(40)]


def test_what_the_trees_look_at():
    """Nodes a search visits: near 0 bits nearly none, at the radius most of them; the bands do the narrowing."""
    r = random.Random(10)
    fps = [r.getrandbits(128) for _ in range(512)]

    class Counted(dict):
        seen = 0

        def items(self):
            Counted.seen += 1
            return super().items()

    tree = BKTree()
    for i, f in enumerate(fps):
        tree.add(f, i)
    tree.kids = [Counted(k) for k in tree.kids]
    share = []
    for radius in (0, 10, RADIUS):
        Counted.seen = 0
        for f in fps[:64]:
            tree.within(f, radius)
        share.append(Counted.seen / 64 / len(fps))
    assert share[0] < 0.05 and share[0] < share[1] < share[2] <= 1.0


def test_a_tree_at_a_path_takes_batches(spark, tmp_path):
    from palimpsest.llm.p3_cutoff import append_batch, stored_tree

    r = random.Random(3)
    # scores that agree in their first 32 bits, so that the leaf is refined
    rows = [(i, "a", 100.0 + r.randrange(3000) * 1e-9) for i in range(900)]
    df = coded(spark.createDataFrame(rows, "rec_id long, source string, score double"), "rec_id")
    for k in range(3):
        append_batch(df.filter(f"id % 3 = {k}"), str(tmp_path / "tree"))
    tree = stored_tree(spark, str(tmp_path / "tree"))
    assert sorted(map(tuple, tree.collect())) == sorted(map(tuple, build_tree(df).collect()))
    c = cutoffs(df, tree, spark.createDataFrame([("a", 37)], "source string, keep_pct int")).first()
    assert (c.k, c.cutoff) == (333, sorted((s for *_, s in rows), reverse=True)[332])
