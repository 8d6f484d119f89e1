"""Operators 1 to 5, 8 and 9 against brute force, round trips and held-out accuracy."""

import hashlib
import os
import random
import re
import zlib
from html import unescape

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.llm import block_extract as B
from foliospark.llm import chat_format as C
from foliospark.llm import decontaminate as D
from foliospark.llm import hashed_text as H
from foliospark.llm import minhash_dedup as M
from foliospark.llm import quality as Q
from foliospark.llm import token_tables as K
from foliospark.llm import toxicity as X
from foliospark.llm.queries import tokenizer_path
from foliospark.llm.textvec import WordHasher, shingle_sets

DOCS = "doc_id long, text string, digest string, rep string, n int, id long, source string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))


def documents(spark, texts, ids=None):
    """Documents with extra columns whose names clash with the operators' own."""
    rows = [(i, t, "d", "r", 1, 7, None) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def encoder():
    return K.Encoder(tokenizer_path())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab Zé's12 \n\t\u00a0\u3000-,.<|>endoftx😀\x00"), max_size=40), min_size=1, max_size=20))
def test_unit_encoding_equals_whole_texts(tokenizer, encoder, texts):
    ids, offsets = encoder(pa.array(texts))
    for t, a, b in zip(texts, offsets[:-1], offsets[1:]):
        assert ids[a:b].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "a <|endoftext| > b", " <|endoftext|>\n"])
def test_special_tokens_are_taken_as_the_library_does(tokenizer, encoder, text):
    ids, offsets = encoder(pa.array(["plain text", text, "and more of it"]))
    assert ids[offsets[1] : offsets[2]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_token_tables(spark, tokenizer):
    texts = ["b c", None, "", "a  b \n c", LONG, "b c", "tail\n\n\n x"]
    manifest = K.write(documents(spark, texts, [5, 9, -3, 2**40, 7, 5, None]), tokenizer_path(), shard_bytes=200_000)
    out = K.read(manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == [None, -3, 5, 5, 7, 9, 2**40]
    at, by_id = 0, {-3: "", 7: LONG, 9: "", 2**40: "a  b \n c", 5: "b c", None: "tail\n\n\n x"}
    for r in out:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["start"] == at and ids == [*tokenizer.encode(by_id[r["doc_id"]], add_special_tokens=False).ids, 0]
        at += len(ids)
    assert manifest.count() > 1
    found = {k: [x.tolist() for r in manifest.collect() for x in K.ShardReader(r["path"]).get(k)] for k in (5, 9, 8, None)}
    assert len(found[5]) == 2 and found[9] == [[0]] and found[8] == [] and len(found[None]) == 1
    digests = K.digest(K.read(manifest)).where("doc_id = 5").collect()
    assert {r["ids_crc32"] for r in digests} == {zlib.crc32(np.array(found[5][0], "<u4").tobytes())}
    assert K.read(K.write(documents(spark, []), tokenizer_path())).count() == 0


def test_blocks_share_key_prefixes(tmp_path):
    path = tmp_path / "t.sst"
    with open(path, "wb") as f:
        w = K.ShardWriter(f, 2)
        for i in range(30_000):
            w.add(K.key_of(i * 3), np.array([i % 50_000, 0], "<u2").tobytes())
        w.close()
    r = K.ShardReader(f"file://{path}")
    assert len(r.blocks) > 3 and r.n_docs == 30_000
    assert [x.tolist() for x in r.get(3 * 20_000)] == [[20_000, 0]] and r.get(1) == []
    assert sum(r.may_have(K.key_of(3 * i + 1)) for i in range(2000)) < 60
    assert [K.id_of(k) for k, _ in r.scan()] == list(range(0, 90_000, 3))


CHATS = "conv_id long, turn long, role string, text string, turns string, formatted string"


def chat(rows):
    return [(*r, "x", "y") for r in rows]


def test_chat_round_trip(spark):
    parts = ["</s>", "[INST]", "[/INST]</s>", "%3C", "<s>user[INST]", "[INST%]", "é😀", "\n", " ", "plain", "[/INST"]
    rng, rows = random.Random(3), []
    for conv in range(60):
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "sy<s[tem", None]), rng.choice([None, "", "".join(rng.choices(parts, k=rng.randint(0, 5)))])))
    rows += [(None, None, None, None), (900, 1, "assistant", "twice"), (900, 1, "assistant", "twice"), (901, 0, "assistant", LONG)]
    chats = C.format_chats(spark.createDataFrame(chat(rows), CHATS))
    out = {r["conv_id"]: r for r in C.digest(chats).collect()}
    spans = {r["conv_id"]: r for r in chats.select("conv_id", "formatted", C.parse(F.col("formatted")).alias("turns"), C.loss_spans(F.col("formatted")).alias("spans")).collect()}
    assert len(out) == len({r[0] for r in rows})
    for conv, r in out.items():
        own = sorted(((x[1] if x[1] is not None else -1, x[2] or "", x[3] or "") for x in rows if x[0] == conv))
        said = "".join(f"{role}\n{text}\n" for _, role, text in own)
        loss = [text for _, role, text in own if role == "assistant"]
        assert r["n_turns"] == len(own) and r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["loss_chars"] == len("".join(loss)) and r["loss_sha256"] == hashlib.sha256("".join(loss).encode()).hexdigest()
        shown = spans[conv]["formatted"]
        assert r["formatted_chars"] == len(shown)
        plain = lambda s: s.replace("%5B", "[").replace("%3C", "<").replace("%25", "%")
        assert [shown[a:b] in (t, t.replace("%", "%25").replace("<", "%3C").replace("[", "%5B")) or plain(shown[a:b]) == t for t, (a, b) in zip(loss, spans[conv]["spans"])] == [True] * len(loss)
    assert C.format_chats(spark.createDataFrame([], CHATS)).count() == 0


def test_no_control_string_is_left_in_a_text(spark):
    shown = C.format_chats(spark.createDataFrame(chat([(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "fine")]), CHATS)).first()["formatted"]
    assert shown == "<s>user[INST%]%3C/s>%5BINST] ok %5B/INST][/INST]</s><s>assistant[INST]fine[/INST]</s>"


def test_only_turns_that_need_it_are_escaped(spark):
    rows = [(1, 0, "user", "a [/INST]</s> b"), (1, 1, "assistant", "fine"), (1, 2, "user", "50 % < [x]"), (2, 0, "user", "[/INST]</s>" * 3), (2, 1, "assistant", "<s>x[INST%]"), (2, 2, "user", "plain")]
    out = {r["conv_id"]: r for r in C.format_chats(spark.createDataFrame(chat(rows), CHATS)).collect()}
    assert out[1]["escaped_turns"] == 1 and out[2]["escaped_turns"] == 2
    assert "[INST]50 % < [x][/INST]</s>" in out[1]["formatted"] and out[2]["formatted"].endswith("<s>user[INST]plain[/INST]</s>")


def sets_of(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("aAbé \t\n\x0b\u00a0", max_size=60), min_size=1, max_size=12))
def test_shingle_sets_have_the_right_sizes(texts):
    assert [len(s) for s in shingle_sets(WordHasher(), pa.array(texts))] == [len(s) for s in sets_of(texts)]


def near_copies(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=3))
    texts = []
    for _ in range(n):
        base = [word() for _ in range(rng.randint(3, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            other = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                other[rng.randrange(len(other))] = word()
            texts.append(" ".join(other))
    return texts


def test_near_duplicates_equal_brute_force(spark):
    texts = [*near_copies(1, 40), None, "", " \t", "one two", "One two", "ONE TWO three", LONG, LONG + " end"]
    ids = list(range(100, 100 + len(texts)))
    random.Random(2).shuffle(ids)
    sets, root = sets_of(texts), {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(ids[a]), find(ids[b])))
                root[y] = x
    out = {r["doc_id"]: tuple(r)[1:] for r in M.near_duplicates(documents(spark, texts, ids)).collect()}
    assert out == {i: (len(s), find(i), find(i) == i) for i, s in zip(ids, sets)}
    kept = M.keep_one(documents(spark, [*texts, "null id"], [*ids, None]))
    assert kept.columns == documents(spark, []).columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i in ids if find(i) == i} | {None}


def test_texts_of_a_repeated_id_all_link(spark):
    words = lambda p, n=40: " ".join(f"{p}{i}" for i in range(n))
    texts = [words("a"), words("b"), words("a") + " end", words("b") + " end", words("c"), words("c"), "", words("d"), words("e"), words("e")]
    ids = [50, 50, 60, 70, 80, 80, 90, 90, 100, 95]
    expected = {50: 50, 60: 50, 70: 50, 80: 80, 90: 90, 95: 95, 100: 95}
    for order in (list(range(10)), list(range(9, -1, -1)), [1, 0, *range(2, 10)]):
        out = M.near_duplicates(documents(spark, [texts[i] for i in order], [ids[i] for i in order])).collect()
        assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in out) == sorted((i, expected[i], expected[i] == i) for i in ids)
    kept = M.keep_one(documents(spark, texts, ids)).collect()
    assert sorted(r["doc_id"] for r in kept) == [50, 50, 80, 90, 90, 95]


def test_large_group_of_near_copies_and_empty_table(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(w if rng.random() > 0.02 else f"z{rng.randrange(999)}" for w in base) for _ in range(700)]
    sets = sets_of(texts)
    out = M.near_duplicates(documents(spark, texts)).toPandas().set_index("doc_id")
    for a in rng.sample(range(700), 60):
        for b in range(700):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                assert out.component_id[a] == out.component_id[b]
    assert M.near_duplicates(documents(spark, [])).count() == 0


def test_pruning_keeps_what_is_likely():
    steps = M.min_matches(0.75, 1e-5, 128, 32)
    assert [n for n, _ in steps] == [32, 64, 96, 128] and all(0 < m < 0.75 * n for n, m in steps)
    a = np.arange(100, dtype=np.uint64)
    assert M.similar(a[:75], a) and not M.similar(a[:74], a) and not M.similar(a[:0], a[:0])


def labelled(n, seed):
    rng = random.Random(seed)
    good, bad = [f"word{i}" for i in range(400)], ["vile", "scumlike", "trashy"]
    texts = [[rng.choice(good) for _ in range(rng.randint(20, 200))] for _ in range(n)]
    toxic = [rng.random() < 0.2 for _ in range(n)]
    for t, y in zip(texts, toxic):
        for _ in range(max(1, len(t) // 40) * y):
            t[rng.randrange(len(t))] = rng.choice(bad)
    return [" ".join(t) for t in texts], [int(y) for y in toxic]


def test_toxicity_on_held_out_rows(spark):
    texts, toxic = labelled(1500, 7)
    docs = documents(spark, [*texts, None, "", LONG])
    labels = spark.createDataFrame([(i, y if i % 50 else None) for i, y in enumerate(toxic)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in X.score(docs, X.train(docs, labels)).collect()}
    assert len(out) == 1503
    held = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in out.items() if r["held_out"]} & set(range(1500)) == set(held)
    hits = [(out[i]["predicted"], toxic[i]) for i in held]
    assert sum(p == y for p, y in hits) >= 0.95 * len(hits)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out.values())
    assert out[1500]["predicted"] == out[1501]["predicted"] == out[1502]["predicted"] == 0
    assert {r["score"] for r in X.score(docs, X.train(docs, labels.where("toxic = 0"))).collect()} == {0.0}
    assert X.score(documents(spark, []), X.train(documents(spark, []), labels)).count() == 0
    kept = X.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r["predicted"] for r in out.values())


def test_rows_with_a_null_id_are_judged_too(spark):
    texts, toxic = labelled(400, 9)
    bad, clean = next(t for t, y in zip(texts, toxic) if y), next(t for t, y in zip(texts, toxic) if not y)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    docs = documents(spark, [*texts, bad, clean, None], [*range(400), None, None, None])
    assert sorted(map(str, (r["text"] for r in X.drop_toxic(docs, labels).where("doc_id is null").collect()))) == sorted(["None", clean])
    item = "an item of the benchmark that is long enough to be told from the rest of the texts"
    table = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = documents(spark, ["x " + item, clean, "y " + item, clean, None], [1, 2, None, None, None])
    assert sorted(str((r["doc_id"], r["text"])) for r in D.drop_contaminated(docs, table).collect()) == sorted(map(str, [(2, clean), (None, clean), (None, None)]))
    near = bad.split() + ["end"]
    docs = documents(spark, [bad, " ".join(near), "alone in here " + clean, "alone in here " + clean, None], [7, None, None, None, None])
    assert sorted(str((r["doc_id"], r["text"])) for r in M.keep_one(docs).collect()) == sorted(map(str, [(7, bad), (None, "alone in here " + clean), (None, None)]))


def test_labels_of_held_out_rows_are_never_read(spark):
    texts, toxic = labelled(300, 8)
    docs = documents(spark, texts)
    rows = [(i, y) for i, y in enumerate(toxic)]
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in rows]
    scores = [{r["doc_id"]: r["score"] for r in X.score(docs, X.train(docs, spark.createDataFrame(x, "doc_id long, toxic int"))).collect()} for x in (rows, flipped)]
    assert scores[0] == scores[1]


def test_pu_risk_corrects_a_negative_part():
    risk, gp, gu, corrected = X.pu_risk(np.array([4.0, 5.0]), np.array([-9.0, -8.0]), 0.3)
    assert corrected and risk >= 0 and (gu <= 0).all()
    assert not X.pu_risk(np.array([0.0]), np.array([0.0]), 0.3)[3]


def test_pu_gradient_equals_finite_differences():
    """Where the bracket is negative, the gradient followed is that of the risk less the bracket."""
    rng, prior, soft = np.random.default_rng(1), 0.2, lambda z: np.log1p(np.exp(z))
    for shift in (0.0, -6.0):
        p, u = rng.normal(size=7) - shift, rng.normal(size=11) + shift
        value = lambda p, u: prior * soft(-p).mean() + (soft(u).mean() - prior * soft(p).mean()) * (-1 if shift else 1)
        risk, gp, gu, corrected = X.pu_risk(p, u, prior)
        assert corrected == bool(shift) and (corrected or abs(risk - value(p, u)) < 1e-12)
        for own, g in ((p, gp), (u, gu)):
            for i in range(len(own)):
                ends = []
                for step in (1e-6, -1e-6):
                    own[i] += step
                    ends.append(value(p, u))
                    own[i] -= step
                assert abs((ends[0] - ends[1]) / 2e-6 - g[i]) < 1e-7


def plain_margins(texts, model, shrink):
    """Sums over a text's columns, one text at a time."""
    weight, out = dict(zip(model.vocabulary.tolist(), model.weights.tolist())), []
    for columns in H.features(WordHasher(), pa.array(texts, pa.string())):
        known = [weight[c] for c in columns.tolist() if c in weight]
        out.append(sum(known) / (max(1, len(known)) ** 0.5 if shrink else 1))
    return out


def test_toxicity_equals_plain_scores_and_learns(spark):
    texts, toxic = labelled(900, 11)
    texts += [None, "", texts[0], texts[0]]
    docs = documents(spark, texts, [*range(900), 900, None, 0, 0])
    model = X.train(docs, spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int"))
    assert len(model.weights)
    want = [1 / (1 + np.exp(-m - model.intercept)) for m in plain_margins(texts, model, False)]
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["score"], r["predicted"]) for r in X.score(docs, model).collect())
    ids = [*range(901), -1, 0, 0]
    for g, w in zip(got, sorted(zip(ids, want))):
        assert g[0] == w[0] and abs(g[2] - w[1]) < 1e-12 and g[3] == (g[2] >= 0.5) and g[1] == (w[0] < 0 or zlib.crc32(str(w[0]).encode()) % 5 == 0)
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    pos, neg = ([want[i] for i in held if toxic[i] == y] for y in (1, 0))
    assert np.mean([p > n for p in pos for n in neg]) > 0.95  # weights of zero give every text the same score


def test_rows_are_dropped_by_their_own_text(spark):
    texts, toxic = labelled(400, 9)
    bad, clean = next(t for t, y in zip(texts, toxic) if y), next(t for t, y in zip(texts, toxic) if not y)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    docs = documents(spark, [*texts, bad, clean], [*range(400), 5000, 5000])
    assert [r["text"] for r in X.drop_toxic(docs, labels).where("doc_id = 5000").collect()] == [clean]


def test_ordinal_quality(spark):
    rng = random.Random(4)
    texts, grades = [], []
    for _ in range(1200):
        g = rng.randrange(3)
        texts.append(" ".join(rng.choice([f"good{rng.randrange(9)}", f"word{rng.randrange(50)}"]) if rng.random() < g / 2 else f"junk{rng.randrange(9)}" for _ in range(60)))
        grades.append(g * 2 + 1)
    docs = documents(spark, [*texts, None])
    model = Q.train(docs, spark.createDataFrame(list(enumerate(grades)), "doc_id long, quality int"))
    assert model.grades == [1, 3, 5] and (np.diff(model.thresholds) > 0).all()
    out = {r["doc_id"]: r for r in Q.score(docs, model, least=3).collect()}
    held = [i for i in range(1200) if out[i]["held_out"]]
    assert np.corrcoef([out[i]["expected_grade"] for i in held], [grades[i] for i in held])[0, 1] > 0.85
    assert np.mean([out[i]["kept"] == (grades[i] >= 3) for i in held]) > 0.9
    assert all(1 <= r["expected_grade"] <= 5 for r in out.values())
    none = Q.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {(r["expected_grade"], r["tail_probability"]) for r in Q.score(docs, none).collect()} == {(0.0, 1.0)}


def test_ordinal_gradient_and_plain_scores(spark):
    rng = np.random.default_rng(2)
    x = H.Matrix([rng.choice(6, rng.integers(0, 5), replace=False) for _ in range(30)], 6, True)
    k, w, free = rng.integers(0, 4, 30), rng.normal(size=6), np.array([-1.0, 0.2, -0.3])

    def value():
        cuts = [free[0], free[0] + np.exp(free[1]), free[0] + np.exp(free[1]) + np.exp(free[2])]
        below = lambda c, e: 1 / (1 + np.exp(-(c - e)))
        eta = x.dot(w)
        return -np.mean([np.log((1.0 if g == 3 else below(cuts[g], e)) - (0.0 if g == 0 else below(cuts[g - 1], e))) for g, e in zip(k, eta)])

    loss, d_w, d_free = Q.link_loss(x, k, w, free)
    assert abs(loss - value()) < 1e-9
    for own, g in ((w, d_w), (free, d_free)):
        for i in range(len(own)):
            ends = []
            for step in (1e-6, -1e-6):
                own[i] += step
                ends.append(value())
                own[i] -= step
            assert abs((ends[0] - ends[1]) / 2e-6 - g[i]) < 1e-6
    texts = [f"good{i % 7} word{i % 11} end" if i % 3 else f"junk{i % 5} word{i % 11}" for i in range(300)] + ["", None, "good1"]
    ids = [*range(301), None, 3]
    docs = documents(spark, texts, ids)
    model = Q.train(docs, spark.createDataFrame([(i, (i % 3) + 2 * (i % 2)) for i in range(300)] + [(5, 0), (None, 3)], "doc_id long, quality int"))
    want = []
    for i, m in zip(ids, plain_margins(texts, model, True)):
        above = [1 / (1 + np.exp(t - m)) for t in model.thresholds]
        want.append((-1 if i is None else i, model.grades[0] + sum(p * (b - a) for p, a, b in zip(above, model.grades, model.grades[1:])), above[-1]))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["expected_grade"], r["tail_probability"]) for r in Q.score(docs, model).collect())
    assert np.allclose(got, sorted(want), atol=1e-12)
    assert Q.score(documents(spark, []), model).count() == 0


def test_features_of_copies_are_equal():
    h = WordHasher()
    a, b, c, d = H.features(h, pa.array(["Alpha beta", "alpha  BETA alpha", None, ""]))
    assert a.tolist() == b.tolist() and len(c) == len(d) == 0


def edit_distance_to_substring(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, x in enumerate(t, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.text("ab c", min_size=1, max_size=90), st.text("ab c", max_size=120))
def test_myers_equals_dynamic_programming(p, t):
    best, end = D.myers(D.peq(p), len(p), t)
    assert best == edit_distance_to_substring(p, t)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choices("abcde", k=rng.randint(1, 6))) for _ in range(n))
    items = [text(rng.randint(8, 50)) for _ in range(20)]
    docs = []
    for i in range(60):
        body = list(items[i % 20])
        for _ in range(rng.randint(0, int(0.09 * len(body)))):
            k = rng.randrange(len(body))
            body[k : k + 1] = rng.choice([[], ["z"], [body[k], "q"]])
        docs.append(f"{text(20)}  {''.join(body).upper()}!\n{text(20)}")
    docs += [None, "", LONG, items[0]]
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*items, None, "", "!!"])], "item_id long, text string, distance string")
    out = {(r["doc_id"], r["item_id"]): r["distance"] for r in D.matches(documents(spark, docs), table).collect()}
    ours, theirs = D.normalise(pa.array(docs, pa.string())).to_pylist(), D.normalise(pa.array(items)).to_pylist()
    expected = {}
    for i, t in enumerate(ours):
        for j, p in enumerate(theirs) if len(t) < 5000 else ():
            d = edit_distance_to_substring(p, t)
            if d <= int(D.RATE * len(p)):
                expected[i, j] = d
    assert out == expected
    assert {(r["doc_id"], r["item_id"]) for r in D.matches(documents(spark, docs), table, block_chars=100).collect()} == set(expected)
    left = D.drop_contaminated(documents(spark, docs), table)
    assert left.count() == len(docs) - len({i for i, _ in expected}) and left.columns == documents(spark, []).columns
    assert D.matches(documents(spark, docs), table.limit(0)).count() == 0


def test_short_and_repeated_items_equal_brute_force(spark):
    items = [(1, "a"), (2, "ab cd"), (3, "ab cd"), (None, "zq!"), (5, "x1y2z3w"), (6, "éa"), (7, None), (8, " ?! ")]
    docs = ["xab cdy", "AB  CD", "zzq", "nothing", None, "", "x1y2z3w4", "Éa b", "ab cd", "ab cd"]
    table = spark.createDataFrame(items, "item_id long, text string")
    ours, theirs = D.normalise(pa.array(docs, pa.string())).to_pylist(), D.normalise(pa.array([t for _, t in items], pa.string())).to_pylist()
    want = sorted(str((i, item[0], edit_distance_to_substring(p, t))) for i, t in enumerate(ours) for item, p in zip(items, theirs) if p and t and edit_distance_to_substring(p, t) <= int(D.RATE * len(p)))
    for block_chars in (1 << 20, 3):
        out = D.matches(documents(spark, docs), table, block_chars=block_chars).collect()
        assert sorted(str((r["doc_id"], r["item_id"], r["distance"])) for r in out) == want


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p><p>x";</script></head><body>
<header class="site-header"><p>The name of the site is here and it is not a part of the article at all, is it.</p></header>
<nav><ul><li><a href="/a">the first of them</a></li></ul></nav><div class="cookie-notice">We use cookies and the like on this site, for you and for all of us and the rest.</div>
{main}
<aside><p>This is the side bar with some of the text that is not of the article and should go.</p></aside><form><label>Name of the user</label><input></form>
<section id="comments"><p>This is what I think of it and the rest of the text that was here, as it is.</p></section><footer>&copy; the site</footer></body></html>"""
BODY = ["A short title", "The first of the paragraphs is long enough and it has many of the words that are in the list &amp; more.", "Short.", "And the last of them is here, with a <b>bold</b> word and a\n <a href='x'>link</a> in it, for the test of the rules &#233;."]


@pytest.mark.parametrize("frame", ["<article><h1>{0}</h1><p>{1}<p>{2}</p><p>{3}</p></article>", "<div class='content'><h2>{0}</h2><p>{1}</p><p>{2}</p><p>{3}</p></div>", "<main><div><h1>{0}</h1><p>{1}</p><div>{2}</div><p>{3}"])
def test_main_text(frame):
    text = B.main_text(PAGE.format(main=frame.format(*BODY)))
    plain = ["A short title", "The first of the paragraphs is long enough and it has many of the words that are in the list & more.", "Short.", "And the last of them is here, with a bold word and a link in it, for the test of the rules é."]
    assert text == "\n".join(plain)


TEASER = "<article class='card'><a href='/n'>Another of the stories</a><p>Read more.</p></article>"
OTHER = ["Totocalcio domani pioggia Venezia, Firenze soleggiata, Palermo ventoso, Napoli nuvolosa.", "Breve."]


@pytest.mark.parametrize("frame", [TEASER + "<div>{0}</div>", "<div>{0}</div>" + TEASER, "<div>{0}" + TEASER + "</div>"])
def test_small_article_beside_the_main_text(frame):
    shown = frame.format("<h2>{0}</h2><p>{1}</p><p>{2}</p><p>{3}</p>".format(*BODY))
    lines = B.main_text(PAGE.format(main=shown)).split("\n")
    assert lines == B.main_text(PAGE.format(main=f"<div>{shown.replace(TEASER, '')}</div>")).split("\n") and len(lines) == 4


def test_article_is_a_prior():
    both = B.main_text(PAGE.format(main=f"<article><h1>{BODY[0]}</h1><p>{BODY[3]}</p></article><div><p>{BODY[1]}</p></div>"))
    assert both.split("\n")[0] == BODY[0] and both.split("\n")[-1] == unescape(BODY[1])  # good text beside it stays
    few = "<article><h1>{0}</h1><p>{1}</p><div class='ad'>Buy it</div><p>{2}</p></article>".format(BODY[0], *OTHER)
    assert B.main_text(PAGE.format(main=few)) == "\n".join([BODY[0], *OTHER])  # no stop words, all open
    links = "<article><p>{0}</p><ul><li><a href='/1'>One</a></li><li>{1}</li><li><a href='/2'>Two</a></li></ul></article>".format(BODY[1], "next up")
    assert B.main_text(PAGE.format(main=links)) == unescape(BODY[1])


ARTICLE = f"<h1>{BODY[0]}</h1><p>{BODY[1]}</p><p>{BODY[2]}</p><p>{BODY[3]}</p>"


@pytest.mark.parametrize(
    "frame",
    [
        "<div class='content-sidebar-wrap'><article>{}</article></div>",
        "<div class='has-sidebar'>{}</div>",
        "<div class='page no-sidebar' id='withComments'>{}</div>",
        "<div class='sidebar page'><main>{}</main></div>",
        "<div id='header-page'><div class='menu-x'><article>{}</article></div></div>",
        "<div class='sidebar-left'><div>{}</div></div>",
        "<div class='widget'><article>{}</article><div class='ad'>Buy all of this and the rest of it, as it is the best that you and we have.</div></div>",
    ],
)
def test_names_do_not_drop_the_main_text(frame):
    plain = B.main_text(PAGE.format(main=f"<div>{ARTICLE}</div>"))
    assert B.main_text(PAGE.format(main=frame.format(ARTICLE))) == plain and plain.count("\n") == 3


def test_names_still_drop_other_text():
    more = f"<p>{BODY[1]} {BODY[1]}</p>" * 9
    teaser = f"<article><p>{BODY[1][:70]}</p></article>"
    for part in (f"<div class='ad'>{more}</div>", f"<section id=comments><ol><li class=comment><article class='comment-body'>{more}</article></ol></section>", f"<div class=related>{teaser}</div>", f"<div class='cookie-content-wrap'>{more}</div>", f"<div class=sidebar>{more}</div>"):
        for shown in (f"<article>{ARTICLE}</article>{part}", f"{part}<article>{ARTICLE}</article>"):
            assert B.main_text(PAGE.format(main=shown)) == B.main_text(PAGE.format(main=f"<article>{ARTICLE}</article>"))
    assert B.main_text(f"<article><p>Short.</p></article><div class=ad>{more}</div>") == "Short."
    assert B.main_text("<div class=sidebar>" * 3000 + BODY[2] + "</div>" * 3000) == ""


@pytest.mark.parametrize("mark", ["<p title=5\">{}</p>", "<p title=it's>{}</p>", "<p data-id='ad' title='a hidden menu'>{}</p>", "<p><a href=/x/></a>{}</p>", "<p =\">{}</p>", "<p x= >{}</p>", "<p class=x id=y'>{}</p>"])
def test_quotes_and_odd_attributes(mark):
    assert B.main_text("<div><p>" + unescape(BODY[1]).replace("&", "&amp;") + "</p>" + mark.format(BODY[3]) + "<p>Short.</p></div>").split("\n")[1:] == ["And the last of them is here, with a bold word and a link in it, for the test of the rules é.", "Short."]


def test_inline_parts_that_are_dropped_leave_the_block_whole():
    for inner in ("<span class='ad'>buy <b>it</b></span>", "<span class=ad>" + "<i class=x>" * 40 + "buy</span>", "<span hidden>not shown</span>", "<button>press</button>"):
        assert B.main_text(f"<article><p>It is the first of the texts {inner} and it is long enough to be the text of the page.</p></article>") == "It is the first of the texts and it is long enough to be the text of the page."
    deep = "<p>" + "<span class=x>" * 50 + "It is one of the texts of the page, and it is in many of the spans of it.<p>" + BODY[3] + "</p>"
    assert len(B.main_text(f"<div>{deep}</div>").split("\n")) == 2


def plain_main_text(html):
    """The two passes restated over the standard library's parser, for pages without layout names."""
    from html.parser import HTMLParser

    found, state = [], {"text": "", "linked": 0, "open": [], "a": 0}

    class Reader(HTMLParser):
        def flush(self):
            text = " ".join(state["text"].split())
            if text:
                tags = [t for t, _ in state["open"]]
                bad = any(b for _, b in state["open"])
                found.append([text, state["linked"] / len(text), bad, "article" in tags or "main" in tags, next((t for t in reversed(tags) if t in ("div", "article", "main", "section")), "")])
            state["text"], state["linked"] = "", 0

        def handle_starttag(self, tag, attrs):
            names = set(re.split(r"[^a-z]+", " ".join(v or "" for k, v in attrs if k in ("class", "id")).lower()))
            if tag in B.BLOCK_TAGS:
                self.flush()
            state["a"] += tag == "a"
            if tag not in B.VOID_TAGS:
                inside = any(t in ("article", "main") for t, _ in state["open"])
                state["open"].append((tag, tag in B.DROP_TAGS or tag in B.RAW_TAGS or tag == "header" and not inside or bool(names & B.DROP_NAMES)))

        def handle_endtag(self, tag):
            if tag in B.BLOCK_TAGS:
                self.flush()
            state["a"] -= tag == "a"
            while any(t == tag for t, _ in state["open"]) and state["open"].pop()[0] != tag:
                pass

        def handle_data(self, data):
            if not any(t in B.RAW_TAGS for t, _ in state["open"]):
                state["text"] += data
                state["linked"] += len(" ".join(data.split())) if state["a"] else 0

    reader = Reader(convert_charrefs=True)
    reader.feed(html)
    reader.close()
    reader.flush()
    labels = []
    for text, links, bad, _, _ in found:
        words = re.findall(r"[^\W\d_]+", text.lower())
        stops = sum(w in B.STOP_WORDS for w in words) / max(1, len(words))
        good = len(text) >= B.LONG and stops >= B.STOP_HIGH or len(text) >= 2 * B.LONG and stops >= B.STOP_LOW
        labels.append("bad" if bad or links > B.LINKS else "good" if good else "open")
    out = []
    for i, (text, _, _, inside, _) in enumerate(found):
        label = labels[i]
        if label == "open":
            near = [next((labels[j] for j in side if labels[j] != "open" and (found[j][3] and not found[j][2] or not inside)), None) for side in (range(i - 1, -1, -1), range(i + 1, len(found)))]
            label = "bad" if all(n == "bad" for n in near) else "good"
        if label == "good":
            out.append(text)
    return "\n".join(out)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_extraction_equals_the_two_passes_restated(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in B.extract(pages).collect()}
    want = {r["page_id"]: plain_main_text(r["html"]) for r in pages.collect()}
    assert got == want and sum(map(bool, got.values())) > len(got) / 2


def test_extraction_rows(spark):
    cut = "<article><p>The text of the page is cut off in the middle of the <b"
    deep = "<div>" * 3000 + "<p>The text is deep in the page and it has some of the words of the list in it.</p>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", cut, "x"), (2, "u", deep, "x"), (3, "u", "<script>var a", "x"), (4, "u", "no tags of the kind, but the words of a text that is long enough to be judged", "x")]
    out = B.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in out]
    assert sorted(got, key=str) == sorted([(i, t, len(t)) for i, t in [(1, ""), (2, ""), (None, "The text of the page is cut off in the middle of the"), (2, unescape(deep[15003:-4])), (3, ""), (4, rows[5][2])]], key=str)
    assert B.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
