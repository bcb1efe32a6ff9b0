"""Operators on documents against brute force, and the cases that every operator must survive."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelattice.llm import language_id, minhash_neardup, mixing, packing, queries, substring_dedup, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, spans int, rank int, key string"


def odd(spark):
    """Nulls everywhere, empty and blank texts, a very long text, repeated rows, clashing columns."""
    long = " ".join(f"word{i % 997} and{i % 13}" for i in range(60_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 3), (4, "one", "en", "a", 3), (4, "one", "en", "a", 3), (5, long, "fr", "b", len(long)), (6, long + " end", "fr", None, 9), (None, "no id here", "en", "a", 10), (7, "123 456 !!", "de", "b", 10), (8, "ONE", "en", "a", 3)]
    return spark.createDataFrame([(*r, "x", "y", 1, 2, "k") for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ------------------------------------------------------------------ near duplicates
def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def components(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_near_duplicates_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sets = {r.doc_id: shingles(r.text, 4) for r in docs.collect()}
    ids = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0]
    want = components(pairs, ids)
    got = {r.doc_id: r for r in queries.op10_minmax_neardup(spark, sf).collect()}
    assert {i: got[i].component_id for i in ids} == want
    assert all(got[i].n_shingles == len(sets[i]) and got[i].kept == (want[i] == i) for i in ids)


def test_near_duplicates_in_a_chain_of_a_large_bucket(spark):
    """Copies that drift away step by step: neighbours are linked, ends are not, and all are one component."""
    g = np.random.default_rng(0)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(words)))
        words[int(g.integers(0, 120))] = f"new{i}"
    other = [(1000 + i, " ".join(f"v{i}x{j}" for j in range(50))) for i in range(20)]
    out = {r.doc_id: r.component_id for r in minhash_neardup.near_duplicates(spark.createDataFrame(rows + other, "doc_id long, text string"), shingle=4).collect()}
    sets = {i: shingles(t, 4) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert {i: out[i] for i in sets} == components(pairs, sets)
    assert all(out[i] == i for i, _ in other)


def test_near_duplicates_of_a_repeated_id_with_other_texts(spark):
    one, two = prose(21, 80), prose(22, 80)
    rows = [(3, one), (7, one), (7, two), (9, two + " end"), (11, prose(23, 80))]
    out = minhash_neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(3, 3), (7, 3), (7, 3), (9, 3), (11, 11)]


def test_near_duplicates_of_odd_rows(spark):
    out = minhash_neardup.near_duplicates(odd(spark)).collect()
    assert len(out) == 10
    by = {r.doc_id: r for r in out}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[1].kept and by[2].kept
    assert by[8].component_id == 4 and by[6].component_id == 5 and not by[6].kept
    assert minhash_neardup.near_duplicates(empty(spark)).count() == 0


def test_signature_estimates_similarity():
    g = np.random.default_rng(1)
    mul, add = minhash_neardup._family(400)
    common, x, y = (g.integers(0, 1 << 62, n, dtype=np.uint64) for n in (800, 100, 100))
    a, b = (np.concatenate(minhash_neardup.min_max(np.concatenate([common, o]), mul, add)) for o in (x, y))
    assert abs((a == b).mean() - 0.8) < 0.06


# ------------------------------------------------------------------ mixing
def reshared(sizes, weights, cap=3):
    """Targets by sharing again and again until no source is above its cap."""
    total, capped = sum(sizes), {}
    while True:
        rest = [i for i in range(len(sizes)) if i not in capped]
        left, w = total - sum(capped.values()), sum(weights[i] for i in rest)
        share = {i: left * weights[i] / w for i in rest}
        above = [i for i in rest if share[i] > cap * sizes[i]]
        if not above:
            return [capped.get(i, share.get(i)) for i in range(len(sizes))]
        capped |= {i: cap * sizes[i] for i in above}


def test_targets_by_repeated_sharing(spark):
    g = np.random.default_rng(2)
    for _ in range(4):
        sizes = [int(x) for x in g.integers(0, 3000, 14) ** 2 // 500]
        table = spark.createDataFrame([(f"s{i:02d}", s) for i, s in enumerate(sizes)], "source string, size long")
        got = {r.source: r.target for r in mixing.targets(table).collect()}
        want = reshared(sizes, [(5, 2, 1)[i % 3] for i in range(14)])
        assert [got[f"s{i:02d}"] for i in range(14)] == pytest.approx(want, rel=1e-9)


def test_mix_is_near_its_targets(spark):
    g = np.random.default_rng(3)
    rows = [(i, "w " * int(g.integers(1, 200)), "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [sorted(tuple(r) for r in mixing.taken(docs, slice_rows=n).collect()) for n in (1000, 1000, 5)]
    assert runs[0] == runs[1]
    for run in runs:
        got, want = Counter(), {}
        for _, size, _, target, taken, source, copies in run:
            assert taken == size * copies and 0 <= copies <= 3
            got[source] += taken
            want[source] = target
        assert all(abs(got[s] - want[s]) < 400 for s in want)


def test_mix_of_odd_rows(spark):
    out = mixing.taken(odd(spark)).collect()
    assert len(out) == 10 and all(r.taken <= 3 * r.size for r in out)
    assert {r["size"] for r in out if r.doc_id in (1, 2, 3)} == {0}
    mixed = mixing.mix(odd(spark))
    assert mixed.count() == 10 and "rank" in mixed.columns and dict(mixed.dtypes)["size"] == "bigint"
    assert mixing.taken(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0


def test_mix_of_one_doc_id_for_a_third_of_all_rows(spark):
    """Rows that share a doc_id or have none are drawn like others; where their texts differ, each for itself."""
    rows = [(i if i % 3 else None if i % 2 else 7, f"w{i} " * (1 + i % 5), "hot" if i % 4 else "other") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [sorted((r.doc_id or -1, r.source, r["size"], r.copies) for r in mixing.taken(docs, slice_rows=n).collect()) for n in (1000, 1000, 50)]
    assert runs[0] == runs[1] and len(runs[0]) == len(runs[2]) == 4000
    for out in (mixing.taken(docs), mixing.taken(docs, slice_rows=50), mixing.mix(docs)):
        got = {r.source: (r.words, r.target) for r in out.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("words"), F.max("target").alias("target")).collect()}
        assert out.where("copies > 3").count() == 0
        for words, target in got.values():
            assert abs(words - target) <= 10


# ------------------------------------------------------------------ passages
def prose(seed, n):
    g = np.random.default_rng(seed)
    words = ["".join(g.choice(list("abcdefilmnorstu"), g.integers(2, 9))) for _ in range(n)]
    return " ".join(w.capitalize() if i % 9 == 0 else w + "." if i % 9 == 8 else w for i, w in enumerate(words))


def test_passages_that_repeat_are_cut(spark):
    passage = prose(99, 90)
    rows = [(i, f"{prose(i, 60)} cut off {passage}\n{prose(100 + i, 40)}") for i in range(6)] + [(10, prose(500, 300)), (11, "Of the. It is. " * 3)]
    out = {r.doc_id: r for r in substring_dedup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0].text == rows[0][1] and out[10].text == rows[6][1] and out[11].text == rows[7][1]
    for i in range(1, 6):
        assert 70 <= out[i].removed_words <= 90 and passage[40:] not in out[i].text
        (span,) = out[i].spans
        assert rows[i][1][: span.start] + rows[i][1][span.end :] == out[i].text and rows[i][1][span.start : span.end] in passage + "\n"


def repeated_words(docs, line_words, min_words):
    """Per document the words that lie in a later line or a later window, told on the words themselves."""
    seen, out = {}, {}
    for i, text in docs:
        words, gone, at = text.lower().split(), set(), 0
        for line in text.split("\n"):
            line = line.lower().split()
            if len(line) >= line_words and seen.setdefault(("line", *line), (i, at)) != (i, at):
                gone.update(range(at, at + len(line)))
            at += len(line)
        for n in range(len(words) - min_words + 1):
            if seen.setdefault(tuple(words[n : n + min_words]), (i, n)) != (i, n):
                gone.update(range(n, n + min_words))
        out[i] = gone
    return out


def test_passages_against_brute_force(spark, sf):
    """What goes is what repeats, but for one or two words before a sentence's start; offsets are those of the original."""
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    want, text = repeated_words(docs, substring_dedup.LINE_WORDS, substring_dedup.MIN_WORDS), dict(docs)
    for r in queries.op6_substring_dedup(spark, sf).collect():
        whole, kept, at = text[r.doc_id], [], 0
        for s in r.spans:
            kept.append(whole[at : s.start])
            at = s.end
        assert "".join([*kept, whole[at:]]) == r.text
        gone = {n for n, m in enumerate(re.finditer(r"\S+", whole)) if any(s.start <= m.start() < s.end for s in r.spans)}
        assert gone <= want[r.doc_id] and len(gone) == r.removed_words
        for n in want[r.doc_id] - gone:
            assert n - 1 not in want[r.doc_id] or n - 2 not in want[r.doc_id]


def test_lines_that_repeat_are_cut(spark):
    """A line of 20 words in five documents, differently spaced and cased, goes but for the first; one of 9 words stays."""
    line = " ".join(f"word{i}" for i in range(20))
    rows = [(i, f"{prose(i, 12)}\n{line.upper() if i == 3 else line.replace(' ', '  ')} \nAll rights reserved by the owner of this site.\n{prose(50 + i, 12)}") for i in range(5)]
    out = {r.doc_id: r for r in substring_dedup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0].text == rows[0][1] and out[0].removed_words == 0
    for i in range(1, 5):
        (span,) = out[i].spans
        assert out[i].removed_words == 20 and rows[i][1][span.start : span.end].lower().split() == line.split() and "All rights" in out[i].text


def test_passages_are_cut_to_their_words(spark):
    """Against word-level brute force without units(): passages of 51 to 69 words in mid-sentence, few capitals, also twice in one text."""
    g, width = np.random.default_rng(7), substring_dedup.MIN_WORDS
    vocabulary = ["".join(g.choice(list("abcdefilmnorstu"), g.integers(1, 7))) for _ in range(400)]

    def some(n):
        return list(g.choice(vocabulary, n))

    passages = [some(int(n)) for n in g.integers(51, 70, 20)]
    rows = [(i, " ".join(some(int(g.integers(5, 90))) + passages[i % 20] + some(int(g.integers(0, 90))) + passages[i * 7 % 20] + some(3))) for i in range(60)]
    rows += [(70, "ten words that make a line of a refrain here\n" * 9), (None, rows[0][1]), (71, "Ha " * 40), (72, " ".join(some(width - 1)))]
    seen, want = {}, {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        words, gone = text.lower().split(), set()
        for n in range(len(words) - width + 1):
            if seen.setdefault(tuple(words[n : n + width]), (i, n)) != (i, n):
                gone.update(range(n, n + width))
        want[i] = [w for n, w in enumerate(text.split()) if n not in gone]
    out = substring_dedup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text.split() for r in out} == want
    assert all(r.removed_words == len(dict(rows)[r.doc_id].split()) - len(want[r.doc_id]) for r in out)
    assert want[0] == [] and sum(r.removed_words > 100 for r in out) > 30


def test_passages_of_odd_rows(spark):
    out = substring_dedup.dedup_passages(odd(spark))
    rows = out.collect()
    assert len(rows) == 10 and dict(out.dtypes)["spans"].startswith("array")
    assert {r.doc_id: r.text for r in rows}[1] is None and [r.text for r in rows if r.doc_id == 4] == ["one", "one"]
    assert substring_dedup.dedup_passages(empty(spark)).count() == 0


# ------------------------------------------------------------------ packing and token counts
def test_packing_is_an_exact_round_trip(spark, sf):
    enc = packing.encoder()
    docs = {r.doc_id: [*enc.exact.encode(r.text, add_special_tokens=False).ids, 0] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in queries.op7_packing(spark, sf).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == docs.keys()
    for i, ids in docs.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(part.tobytes())
            at += r.length
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == s[0].tier <= 1024 and at & (at - 1) == 0


def test_packing_by_tiers():
    g = np.random.default_rng(5)
    packer, sequences = packing.Packer(1024, 64, 0), defaultdict(list)
    for i in range(3000):
        packer.add(i, np.zeros(int(g.integers(1, 1500)), "<u4"))
    packer.finish()
    for r in packer.rows:
        sequences[r[5]].append(r)
    tiers = Counter(s[0][7] for s in sequences.values())
    assert all(sum(r[2] for r in s) == s[0][7] for s in sequences.values()) and {1024, 512, 256} <= tiers.keys()
    # A window is opened by a remainder of its own tier, but for the few that close the task.
    assert sum(s[0][2] * 2 <= s[0][7] for s in sequences.values()) <= 11


def test_step_groups_are_dealt_by_tier(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    groups, tokens = defaultdict(set), Counter()
    for r in packing.pack(docs, step_tokens=4096).collect():
        groups[r.step_group].add(r.tier)
        tokens[r.step_group] += r.length
    by = defaultdict(list)
    for group, tiers in groups.items():
        (tier,) = tiers
        by[tier].append(tokens[group])
    assert len(by) > 3
    for tier, totals in by.items():
        assert max(totals) <= 4096 and max(totals) - min(totals) <= tier and len(totals) == -(-sum(totals) // 4096)


def test_packing_of_odd_rows(spark):
    out = packing.pack(odd(spark)).collect()
    assert sum(r.length for r in out if r.doc_id == 1) == 1 and sum(r.length for r in out if r.doc_id == 2) == 1
    assert len([r for r in out if r.doc_id == 4 and r.start == 0]) == 2 and any(r.doc_id is None for r in out)
    assert packing.pack(empty(spark)).count() == 0


def test_fast_ids_equal_exact_ids():
    enc = packing.encoder()
    plain = re.compile(f"[{packing.PLAIN}]")
    chars = [chr(i) for i in range(0x250) if plain.match(chr(i))]
    texts = [f"a{c}b {c} {c}{c}1{c}\n {c}" for c in chars] + ["it's we'll I'D x  y   z \n\n q\r\n\t t", " <|endoftext|> "]
    for t in texts:
        assert enc.fast.encode_ordinary(t) == enc.exact.encode(t, add_special_tokens=False).ids, t
    for t in ("日本語 テスト", "a\u0085b c d", "😀 x́"):
        assert enc.ids(t) == enc.exact.encode(t, add_special_tokens=False).ids


def test_token_rollup_against_brute_force(spark, sf):
    enc, want = packing.encoder(), defaultdict(lambda: [0, 0, 0])
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        for i, v in enumerate((1, len(enc.exact.encode(r.text, add_special_tokens=False).ids), len(r.text))):
            want[r.source, r.lang][i] += v
    got = {(r.source, r.lang): [r.docs, r.tokens, r.chars] for r in queries.op1_token_counts(spark, sf).collect()}
    assert got == dict(want)


def test_token_batches_are_signed_and_idempotent(spark, tmp_path):
    counts = spark.createDataFrame([("a", "en", "t", 5, 20), ("a", "en", "t", 7, 30), (None, "fr", "t", 1, 2)], "source string, lang string, tokenizer string, tokens long, chars long")
    one, two = counts.where("tokens = 5"), counts.where("source is null")
    rollup = token_counts.Rollup(spark, str(tmp_path / "rollup"))
    assert rollup.totals().count() == 0
    assert rollup.commit("b1", token_counts.inserts(counts)) and not rollup.commit("b1", token_counts.inserts(counts))
    assert rollup.commit("b2", token_counts.deletes(two)) and rollup.commit("b3", token_counts.revisions(one, one.withColumn("tokens", F.lit(50).cast("long"))))
    want = [("a", "en", "t", 2, 57, 50)]
    assert [tuple(r) for r in rollup.totals().collect()] == want
    rollup.compact()
    assert not rollup.commit("b2", token_counts.deletes(two))
    assert [tuple(r) for r in rollup.totals().collect()] == want
    (tmp_path / "rollup" / "batch=b4").mkdir()  # a batch whose writer was lost
    assert rollup.commit("b4", token_counts.inserts(two)) and rollup.totals().count() == 2
    rollup.compact()
    assert rollup.totals().count() == 2
    with pytest.raises(ValueError):
        rollup.commit("../x", counts)


def test_a_batch_committed_during_compaction_counts_once(spark, tmp_path, monkeypatch):
    counts = token_counts.count_tokens(odd(spark))
    rollup = token_counts.Rollup(spark, f"{tmp_path}/rollup")
    rollup.commit("a", token_counts.inserts(counts))
    listed, late = rollup.committed, []

    def then_another():
        found = listed()
        if not late:
            late.append(True)
            rollup.commit("b", token_counts.inserts(counts))
        return found

    monkeypatch.setattr(rollup, "committed", then_another)
    rollup.compact()
    assert rollup.totals().agg(F.sum("docs")).first()[0] == 20


def test_token_counts_of_odd_rows(spark):
    out = token_counts.count_tokens(odd(spark)).collect()
    assert len(out) == 10 and {r.tokens for r in out if r.doc_id in (1, 2)} == {0}
    assert token_counts.count_tokens(empty(spark)).count() == 0


# ------------------------------------------------------------------ language
def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op3_language_id(spark, sf).collect()
    held = [r for r in out if r.held_out]
    assert len(out) == len(true) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert len(held) > 200 and sum(true[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.99


def test_language_of_odd_rows(spark):
    docs = odd(spark)
    out = language_id.identify(docs, language_id.train(docs)).collect()
    assert len(out) == 10 and {r.lang_pred for r in out if r.doc_id in (1, 2, 3, 7)} == {"und"}
    assert all(0 <= r.score <= 1 for r in out)
    none = language_id.train(empty(spark))
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}
    assert language_id.annotate(docs, none).count() == 10


def test_decoding_against_brute_force():
    """The nearest codeword by explicit sums, and its share of the likelihoods."""
    g = np.random.default_rng(8)
    words = language_id.code(4)
    model = language_id.Model(list("abcd"), words, g.standard_normal((words.shape[1], 32)).astype(np.float32), g.random(words.shape[1]) + 0.5)
    for x in g.standard_normal((50, 32)).astype(np.float32):
        loss = []
        for word in words:
            margins = [float(sum(float(w) * float(v) for w, v in zip(line, x, strict=True))) for line in model.weights]
            loss.append(sum(t * np.log1p(np.exp(-language_id.SHARPNESS * b * m)) for t, b, m in zip(model.trust, word, margins, strict=True)))
        p = np.exp(min(loss) - np.array(loss))
        i, score, second = model.decode(x)
        assert i == int(np.argmin(loss)) and abs(score - p.max() / p.sum()) < 1e-4 and abs(second - np.sort(p)[-2] / p.sum()) < 1e-4


def test_letters_are_those_of_unicode(spark):
    rows = [(i, f"{'the' if i % 2 else 'das'} {'word' if i % 2 else 'wort'} {i}", "en" if i % 2 else "de", None, 1) for i in range(40)]
    rows += [(100, "½ ² 3", None, None, 1), (101, "ª", None, None, 1), (102, "字", None, None, 1)]
    docs = spark.createDataFrame([(*r, "x", "y", 1, 2, "k") for r in rows], SCHEMA)
    out = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, language_id.train(docs)).collect()}
    assert out[100] == ("und", 0.0) and out[101][0] != "und" and out[102][0] != "und"


def test_the_training_sample_is_bounded(spark, monkeypatch):
    """Also where all rows have one doc_id; languages beyond half the bound are named in a warning."""
    sizes, fit = [], language_id.fit
    monkeypatch.setattr(language_id, "fit", lambda x, y, languages: (sizes.append(len(x)), fit(x, y, languages))[1])
    rows = [(1, f"word {i} of {i % 7}", "en" if i % 3 else "de", None, 1, "x", "y", 1, 2, "k") for i in range(600)]
    language_id.train(spark.createDataFrame(rows, SCHEMA), max_docs=100)
    assert sizes == [100]
    many = [(4 * i, f"word {i}", f"l{i}", None, 1, "x", "y", 1, 2, "k") for i in range(40)]
    with pytest.warns(UserWarning, match="languages are left out"):
        model = language_id.train(spark.createDataFrame(many, SCHEMA), max_docs=20)
    assert len(model.languages) == 10 and sizes[1] <= 20


def test_the_sample_has_the_smallest_hashes(spark):
    """However few rows a part of the range holds: languages of 5000, 40 and 2 rows, and one of rows that all agree."""
    rows = [(i, f"text {i}", lang) for lang, n in (("a", 5000), ("b", 40), ("c", 2)) for i in range(n)] + [(9, "the same", "d")] * 500
    own = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("h", F.xxhash64("doc_id", "text"))
    hashes = defaultdict(list)
    for r in own.collect():
        hashes[r.lang].append(r.h)
    order = language_id.Window.partitionBy("lang").orderBy("h", "doc_id")
    for most in (1, 7, 300):
        got = language_id._bounds(own, {lang: len(h) for lang, h in hashes.items()}, most, order)
        assert got == {lang: sorted(h)[: most][-1] for lang, h in hashes.items()}


def test_codes_are_apart():
    for k in (2, 3, 4, 7, 12):
        c = language_id.code(k)
        d = [(c[i] != c[j]).sum() for i in range(k) for j in range(i)]
        assert len(c) == k and min(d) >= (2 ** (k - 2) if k <= 7 else 8)


def test_features_do_not_depend_on_chunks(monkeypatch):
    text = "The quick brown fox. " * 50
    whole = language_id.features(text)
    monkeypatch.setattr(language_id, "CHUNK", 64)
    assert np.allclose(whole, language_id.features(text))
