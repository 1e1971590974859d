"""Benchmark decontamination, near-duplicates, quality rules, secrets and BPE against brute force."""

from __future__ import annotations

import hashlib
import json
import os
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, common, decontaminate, near_dedup, quality, secrets
from tessera.llm.catalog import vocabulary

WORD, SPACED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")


def low(t: str | None) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


# --- decontamination


def contamination_by_brute_force(docs: list[tuple], items: list[tuple], window: int = 10) -> list[tuple]:
    windows = defaultdict(set)
    for i, t in items:
        w = WORD.findall(low(t))
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[a : a + n])].add("" if i is None else str(i))
    sizes = {len(k) for k in windows}
    out = []
    for i, t in docs:
        w, hit, found = WORD.findall(low(t)), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in windows:
                    hit.update(range(a, a + n))
                    found |= windows[k]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def bench(spark):
    r = random.Random(2)
    items = [(i, " ".join(r.choice("abcdef") for _ in range(r.randint(3, 25)))) for i in range(30)]
    return spark.createDataFrame([*items, (40, None), (41, " ,.; "), (42, items[3][1]), (None, "one")], "item_id long, text string")


def _digest(df) -> list[tuple]:
    return sorted((tuple(r)[:6] for r in df.collect()), key=str)


def test_contamination(spark, odd, none, bench, monkeypatch):
    r = random.Random(3)
    docs = odd.unionByName(spark.createDataFrame([(100 + i, " ".join(r.choice("abcdefg") for _ in range(r.randint(0, 400)))) for i in range(60)], "doc_id long, text string"), allowMissingColumns=True)
    want = contamination_by_brute_force([(x["doc_id"], x["text"]) for x in docs.collect()], [tuple(x) for x in bench.collect()])
    assert _digest(decontaminate.report(docs, bench)) == want
    assert sum(x[-1] for x in want) > 5
    # many blocks and many shards give the same
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 50)
    small = decontaminate.contamination(docs, bench, block_bytes=60)
    whole = decontaminate.contamination(docs, bench)
    key = lambda d: sorted(((x["doc_id"], x["hits"], x["items"], x["longest"]) for x in d.collect()), key=str)
    assert key(small) == key(whole)
    monkeypatch.undo()
    assert key(decontaminate.contamination(docs, bench)) == key(whole)
    # the longest match of each document, and that it is where it is said to be
    texts, items = {x["doc_id"]: WORD.findall(low(x["text"])) for x in docs.collect()}, {"" if i is None else str(i): WORD.findall(low(t)) for i, t in map(tuple, bench.collect())}
    for x in whole.collect():
        if x["doc_id"] is None:
            continue
        words, longest = texts[x["doc_id"]], 0
        for item in items.values():
            for a in range(len(item)):
                for p in range(len(words)):
                    n = 0
                    while a + n < len(item) and p + n < len(words) and item[a + n] == words[p + n]:
                        n += 1
                    longest = max(longest, n if n >= min(10, len(item)) else 0)
        assert x["longest"] == longest, x["doc_id"]
        if longest:
            a, p = x["item_at"], x["longest_at"]
            assert items[x["longest_item"]][a : a + longest] == words[p : p + longest]
    blocks = decontaminate.write_blocks(bench, 10, 60)
    assert len(blocks) > 5 and sum(len(decontaminate._block(p).names) for p in blocks) == bench.count()
    assert decontaminate.report(none, bench).count() == 0 and not decontaminate.report(odd, bench.limit(0)).where("contaminated").count()
    kept = decontaminate.clean(docs, bench)
    assert kept.schema == docs.schema and kept.count() == sum(not x[-1] for x in want)


def test_longest_match_and_its_place(spark):
    docs = spark.createDataFrame([(1, "x y " + "p q r s t u v w x y z zz " * 2)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "n n p q r s t u v w x y z k")], "item_id long, text string")
    r = decontaminate.contamination(docs, bench).first()
    assert (r["longest"], r["longest_item"], r["longest_at"], r["item_at"]) == (11, "7", 2, 2)


def test_suffix_array_is_sorted():
    r = np.random.default_rng(0)
    codes = np.concatenate([r.integers(1, 4, 300), [0, 0]])
    order = decontaminate.suffix_array(codes, 400)
    assert order[codes[order] > 0].tolist() == sorted(np.flatnonzero(codes).tolist(), key=lambda i: codes[i:].tolist())


# --- near-duplicates


def groups_by_brute_force(docs: list[tuple], k: int) -> list[tuple]:
    sets = []
    for _, t in docs:
        w = SPACED.findall(low(t))
        n = min(k, len(w))
        sets.append(frozenset(tuple(w[a : a + n]) for a in range(len(w) - n + 1)) if n else frozenset())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * (c := len(a & sets[j])) >= 80 * (len(a) + len(sets[j]) - c):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)].append(d)
    comp = lambda i: min(least[find(i)], default=None) if sets[i] else docs[i][0]
    return sorted(((d, len(sets[i]), comp(i), d == comp(i)) for i, (d, _) in enumerate(docs)), key=str)


@pytest.fixture(scope="module")
def copies(spark, odd):
    """Chains and stars of edited copies, at many distances around the threshold."""
    r = random.Random(9)
    rows = []
    for _ in range(12):
        words = [f"w{r.randrange(500)}" for _ in range(r.choice([12, 60, 150]))]
        for _ in range(r.randint(2, 12)):
            rows.append((1000 + len(rows), " ".join(words)))
            if r.random() < 0.7:
                words = list(words)
                for _ in range(max(1, len(words) // r.choice([20, 60, 100]))):
                    words[r.randrange(len(words))] = f"w{r.randrange(500)}"
    r.shuffle(rows)
    return odd.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(copies, none, k):
    want = groups_by_brute_force([(r["doc_id"], r["text"]) for r in copies.collect()], k)
    assert sorted(map(tuple, near_dedup.near_duplicates(copies, k=k).collect()), key=str) == want
    assert len({w[2] for w in want}) < len(want) - 20
    assert near_dedup.near_duplicates(none, k=k).count() == 0


def test_one_of_each_group_stays(copies, none):
    kept = near_dedup.clean(copies)
    want = groups_by_brute_force([(r["doc_id"], r["text"]) for r in copies.collect()], 5)
    with_words = [r for r in kept.collect() if SPACED.findall(r["text"] or "")]
    assert kept.columns == copies.columns and len(with_words) == len({w[2] for w in want if w[1]})
    assert len({r["doc_id"] for r in with_words}) == len(with_words)
    assert kept.count() - len(with_words) == sum(w[1] == 0 for w in want)
    assert near_dedup.clean(none).count() == 0


def working_tables(spark) -> Counter:
    """Labels of the working tables that hold rows."""
    root = common.shared_dir(spark).removeprefix("file://")
    return Counter(d.split("-")[1] for d in os.listdir(root) if d.startswith("tessera-") and any(f.startswith("part-") for f in os.listdir(f"{root}/{d}")))


def test_near_duplicate_search_drops_what_its_result_does_not_read(spark, copies):
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, before = spark.conf.get(cleanup), working_tables(spark)
    plain = near_dedup.clean(copies.where("doc_id >= 1000"))
    assert working_tables(spark) - before == Counter(["leave"])
    want = groups_by_brute_force([(r["doc_id"], r["text"]) for r in copies.collect() if (r["doc_id"] or 0) >= 1000], 5)
    assert {r["doc_id"] for r in plain.collect()} == {w[0] for w in want if w[3]}
    before = working_tables(spark)
    found = near_dedup.near_duplicates(copies, k=4)
    assert working_tables(spark) - before == Counter(["rows", "named"])
    assert found.count() == copies.count() and spark.conf.get(cleanup) == was


def test_shuffle_files_go_with_their_job(spark):
    on_disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", on_disk.getAllFiles().mkString("\n")))
    before = files()
    table = common.settled(spark.range(10_000).repartition(3).groupBy((F.col("id") % 100).alias("k")).count(), "test")
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and table.count() == 100


def test_components_of_a_long_chain(spark):
    n = 40
    edges = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(n)] + [(bytes([100]), bytes([101]))], "a binary, b binary")
    got = {r["node"][0]: r["comp"][0] for r in near_dedup.components(edges).collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 100: 100, 101: 100}


def test_sketches_let_similar_pairs_pass(spark):
    r = np.random.default_rng(5)
    rows, far = [], 0
    for n in (30, 200, 1500, 6000):
        for _ in range(40):
            both = r.integers(0, 2**64, n, dtype=np.uint64)
            own = n // 8
            a, b = (np.unique(np.concatenate([both, r.integers(0, 2**64, own, dtype=np.uint64)])) for _ in range(2))
            rows.append((len(a), len(b), near_dedup.odd_sketch(a).tolist(), near_dedup.odd_sketch(b).tolist(), True))
            a, b = (np.unique(np.concatenate([both[: n // 2], r.integers(0, 2**64, n // 2, dtype=np.uint64)])) for _ in range(2))
            rows.append((len(a), len(b), near_dedup.odd_sketch(a).tolist(), near_dedup.odd_sketch(b).tolist(), False))
            far += 1
    df = spark.createDataFrame(rows, "na long, nb long, a array<long>, b array<long>, similar boolean")
    got = df.where(near_dedup.may_be_similar(F.col("na"), F.col("nb"), near_dedup._longs("a"), near_dedup._longs("b"), 80)).groupBy("similar").count().collect()
    # all similar pairs pass; of the others just those of 30 shingles each, of which sketches aren't asked
    assert dict(map(tuple, got)) == {True: far, False: 40}


# --- quality


def counts_by_brute_force(t: str | None) -> tuple:
    t = t or ""
    w = SPACED.findall(t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen, often, covered, dup = set(), Counter(grams), set(), 0
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered.update(range(i, i + 5))
    for line in t.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_counts(odd, none, documents):
    for df in (odd, documents):
        texts = Counter((r["doc_id"], counts_by_brute_force(r["text"])) for r in df.collect())
        got = Counter((r[0], tuple(r)[1:7]) for r in quality.counts(df).collect())
        assert got == texts
    assert quality.counts(none).count() == 0


def test_learned_rules_reject_what_is_labelled_bad(spark):
    r = random.Random(6)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(n))
    rows = [(i, (" ".join(w + "%$" for w in prose(80).split()) if i % 5 == 0 else prose(80)), "en", "s", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 400) if i % 4 != 3] + [(None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x["kept"] for x in quality.judged(docs, labels).collect()}
    assert got == {i: i % 5 != 0 for i in range(400)}
    assert {x["doc_id"] for x in quality.clean(docs, labels).collect()} == {i for i in range(400) if i % 5}
    without = quality.judged(docs, labels.limit(0))
    assert without.where("not kept").count() == 0


def binned(spark, rows):
    """Rows as labelled_bins() gives them: named features, all others in bin 0."""
    names = ["bad", "held", *quality.FEATURES]
    return spark.createDataFrame([tuple(r.get(n, 0) if n != "held" else r["held"] for n in names) for r in rows], "bad int, held boolean, " + ", ".join(f"{f} int" for f in quality.FEATURES))


def test_conjunctions_pruning_and_order(spark):
    r = random.Random(2)
    # bad is symbols above bin 6 together with digits above bin 4; and, less often, many marks
    rows = []
    for i in range(3000):
        x = {"symbol_share": r.randrange(12), "digit_share": r.randrange(12), "mark_share": 15 if i % 20 == 0 else r.randrange(4), "held": i % 3 == 0}
        rows.append(x | {"bad": int(x["symbol_share"] > 6 and x["digit_share"] > 4 or x["mark_share"] == 15)})
    rules = quality.learn(binned(spark, rows))
    wrong = lambda rules: sum(any(all((x[l.feature] > l.bin) == l.above for l in rule) for rule in rules) != bool(x["bad"]) for x in rows)  # noqa: E731, E741
    both = [rule for rule in rules if {x.feature for x in rule} == {"symbol_share", "digit_share"}]
    assert len(both) == 1 and {(x.feature, x.bin, x.above) for x in both[0]} == {("symbol_share", 6, True), ("digit_share", 4, True)}
    assert any({x.feature for x in rule} == {"mark_share"} for rule in rules) and wrong(rules) == 0
    # most bad documents a literal first: the list is in the order in which the rules were found, and CASE names the first that applies
    stats = spark.createDataFrame([(0.9, 0.9, 0.9), (0.9, 0.9, 0.0), (0.0, 0.0, 0.9), (0.9, 0.0, 0.0)], "symbol_share double, digit_share double, mark_share double")
    got = [x[0] for x in stats.select(quality.verdict([tuple(both[0]), next(u for u in rules if u[0].feature == "mark_share")])).collect()]
    assert got == [1, 1, 2, 0]


def test_a_literal_that_only_fits_the_growing_rows_is_pruned(spark):
    r = random.Random(4)
    rows = []
    for i in range(1500):
        held, bad = i % 3 == 0, int(r.random() < 0.3)
        # on the growing rows a few good ones have symbols too, and the upper share tells them apart; on the held-out rows it tells nothing
        noise = not held and not bad and r.random() < 0.1
        rows.append({"bad": bad, "held": held, "symbol_share": 9 if bad or noise else 1, "upper_share": (0 if noise else 9) if not held else r.randrange(10)})
    rules = quality.learn(binned(spark, rows))
    assert [[x.feature for x in rule] for rule in rules] == [["symbol_share"]]
    # and a rule that is not exact enough on the held-out rows is not kept at all
    assert quality.learn(binned(spark, [x | {"symbol_share": r.randrange(10)} if x["held"] else x for x in rows])) == []
    # neither is one that is exact but covers too few of them
    few = [x for x in rows if not (x["held"] and x["bad"])] + [x for x in rows if x["held"] and x["bad"]][: quality.LEAST_COVER - 1]
    assert quality.learn(binned(spark, few)) == []


def test_clean_keeps_columns(odd, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = quality.clean(odd, labels)
    assert kept.columns == odd.columns and kept.count() == sum(not counts_by_brute_force(r["text"])[-1] for r in odd.collect())


def test_clean_writes_no_text(spark, odd, documents, monkeypatch):
    labels = documents.select("doc_id", F.when(F.length("text") % 3 == 0, 0).otherwise(1).alias("quality")).where("doc_id % 4 > 0")
    docs = documents.unionByName(odd.select(documents.columns))
    judged = quality.judged(docs, labels, "text").where("kept").select("doc_id", "text").collect()
    before = working_tables(spark)
    for few in (quality.FEW_LABELLED, 0):
        monkeypatch.setattr(quality, "FEW_LABELLED", few)
        kept = quality.clean(docs, labels)
        assert working_tables(spark) == before
        assert Counter(kept.select("doc_id", "text").collect()) == Counter(judged) and kept.columns == docs.columns


def test_sketches_do_not_rule_out_short_texts(spark):
    """12 of 15 shingles in common, and sketches that differ in more bits than most_bits() allows so few."""
    rows = [(13, 14, [31] + [0] * 31, [0] * 32), (900, 920, [-1] * 32, [0] * 32)]
    got = spark.createDataFrame(rows, "n long, na long, sketch array<long>, ska array<long>")
    kept = near_dedup.may_be_similar(F.col("n"), F.col("na"), near_dedup._longs("sketch"), near_dedup._longs("ska"), 80)
    assert [r[0] for r in got.where(kept).select("n").collect()] == [13]


# --- secrets


def test_hot_hashes_and_repositories(spark, monkeypatch):
    """A third of all rows hold one value: its rows stay where they are. One owner's value in many repositories is live, several owners' is copied."""
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    popular, own, several, two = "Ab3dEfGh1jKlMnOpQrStUvWx9z", "Zx8cVb7nMq2wErT5yUiOp3aSdF", "Qw4eRt6yUi8oPa1sDf3gHj5kLz", "Mn9bVc7xZl5kJh3gFd1sAp0oIu"
    value = lambda i: popular if i % 3 == 0 else own if i < 30 else several if i < 60 else two
    rows = [(i, f"a {value(i)} b", f"o{i % 7}" if i % 3 == 0 else "o1" if value(i) == own else f"o{i % 2}", f"r{i % 9}" if value(i) != two else f"r{i % 2}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, owner string, repository string")
    got = {r["doc_id"]: (r["n_live"], r["n_example"]) for r in secrets.report(docs, F.col("owner"), F.col("repository")).collect()}
    assert got == {i: (0, 1) if value(i) in (popular, several) else (1, 0) for i in range(90)}
    plan = secrets.judged(secrets.scan(docs, F.col("owner"), F.col("repository")))._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan


def base_secrets(t: str | None) -> list[tuple[int, int, int]]:
    t, out = t or "", []
    for m in re.finditer(r'(password|passwd|secret|token|api_?key)["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)', t, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])


def test_secrets(spark, odd, none):
    r = random.Random(8)
    bits = ["token", "password=", "API_KEY : ", "secret:", "'", '"', " = ", "AKIA", "ABCDEFGH12345678", "deadbeef" * 4, "é", "\x01", "x.y=z", "\n", "short", "passwd"]
    rows = [(100 + i, "".join(r.choice(bits) for _ in range(r.randint(0, 14))), f"s{i % 4}") for i in range(300)]
    rows.append((999, "token=abcdefgh12 " * 3000 + ("f" * 31 + " ") * 3000, "s1"))
    docs = odd.unionByName(spark.createDataFrame(rows, "doc_id long, text string, source string"), allowMissingColumns=True)
    got = secrets.report(docs, F.col("source"), F.col("lang")).collect()
    want = Counter()
    for x in docs.collect():
        s = base_secrets(x["text"])
        text = ",".join(f"{secrets.BASE[k]}:{a}:{b}" for a, k, b in s)
        want[x["doc_id"], *(sum(y[1] == k for y in s) for k in range(3)), sha(text)] += 1
    assert Counter(tuple(x)[:5] for x in got) == want
    assert secrets.report(none, F.col("source"), F.col("lang")).count() == 0


def test_examples_and_live_secrets(spark):
    shared, own = "Ab3dEfGh1jKlMnOpQrStUvWx9z", "Zx8cVb7nMq2wErT5yUiOp3aSdF"
    rows = [(i, f"key {shared} here", f"owner{i}", "r") for i in range(5)] + [(9, f"key {own} here", "owner9", "r"), (9, f"key {own} here", "owner9", "r")]
    got = secrets.report(spark.createDataFrame(rows, "doc_id long, text string, owner string, repo string"), F.col("owner"), F.col("repo")).collect()
    assert len(got) == 7
    for x in got:
        assert (x["n_live"], x["n_example"], x["spans"]) == ((1, 0, "token:4:30") if x["doc_id"] == 9 else (0, 1, ""))


def test_tokens_after_delimiters(spark):
    """Unquoted values of settings, URL parameters, path segments and parts between dots are candidates; base spans are not repeated."""
    aws, own = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzExam1pleK", "Zx8cVb7nMq2wErT5yUiOp3aSdF"
    texts = {
        f"AWS_SECRET_ACCESS_KEY={aws}": [aws], f"GITHUB_PAT=ghp_{own}9": [f"ghp_{own}9"], f"https://a.org/f?x=1&sig={own}&y=2": [own], f"https://hooks.a.com/services/T0/{own}/end": [own],
        f"{own}.Q{aws}.R{own}": [own, f"Q{aws}", f"R{own}"], f"a {own}== b": [f"{own}=="], f"secret={own}": [],
    }
    docs = spark.createDataFrame([(i, t, f"o{i % 2}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(docs, F.col("source"), F.col("source")).collect()}
    for i, (t, want) in enumerate(texts.items()):
        assert [t[s["start"] : s["end"]] for s in got[i] if s["kind"] == len(secrets.BASE)] == want, t


# --- BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("word_bpe_49k.json"))


def test_ids_and_texts_are_the_librarys(odd, none, documents, library):
    for df in (odd, documents):
        want = Counter()
        for r in df.collect():
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(library.decode(ids, skip_special_tokens=False))] += 1
        assert Counter(map(tuple, bpe.encode(df, vocabulary("word_bpe_49k.json")).collect())) == want
    assert bpe.encode(none, vocabulary("word_bpe_49k.json")).count() == 0


def test_memory_for_pairs_is_bounded(library, monkeypatch):
    """Long unbroken words are never remembered, so the pairs that they ask about must be bounded by themselves."""
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 500)
    e = bpe.Encoder(json.loads(bpe.read_spec(vocabulary("word_bpe_49k.json"))))
    r = random.Random(3)
    for _ in range(4):
        word = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000))
        assert np.frombuffer(e.encode(word), "<u4").tolist() == library.encode(word, add_special_tokens=False).ids
        assert len(e.apart) <= 500
    assert not dict(e)


def test_random_words(library):
    e, r = bpe.encoder(bpe.read_spec(vocabulary("word_bpe_49k.json"))), random.Random(3)
    for _ in range(1500):
        t = "".join(r.choice("aaabcdehinorst'!0 ") if r.random() < 0.9 else chr(r.choice([r.randrange(160, 0x2000), r.randrange(0x1F300, 0x1FA00)])) for _ in range(60))
        ids = e.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t
        assert e.decode(ids) == library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
