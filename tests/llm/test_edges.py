"""Corpus operators: odd column names, repeated rows, ties, empty tables, and cases whose answers are worked out here."""

import hashlib
import random
import re
import string
import uuid
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from slotweave.llm import dac, decontaminate, jaccard, licenses, packing, quality, secrets, sharding, tokens, toxicity

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def prose(r, n, vocabulary=3000):
    return " ".join(f"w{r.randrange(vocabulary)}x" for _ in range(n))


def edited(r, text, changes):
    words = text.split(" ")
    for _ in range(changes):
        words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
    return " ".join(words)


def components_by_force(texts, size, num, den):
    """Smallest index reachable by links, and the set sizes."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    of = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j]) if of[i] != of[j] else 0
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((of[i], of[j]))
                of = [low if x == high else x for x in of]
    return of, [len(s) for s in sets]


def near_copies():
    """Near copies around the thresholds, of texts of 5 to 3,000 words, and passages that many texts share."""
    r = random.Random(11)
    texts, passage = [], prose(r, 60)
    for n in (300, 450, 700, 1100, 3000):
        base = prose(r, n, 100_000)
        for changes in (0, 1, n // 60, n // 40, n // 30, n // 25, n // 20):
            texts.append(edited(r, base, changes))
        texts += [f"{base} {prose(r, n // 10)}", f"{base} {prose(r, n // 4)}", f"{base[: len(base) // 2]}"]
    group = prose(r, 160, 100_000)
    texts += [edited(r, group, r.randrange(8)) for _ in range(60)]
    texts += [f"{prose(r, 120, 100_000)} {passage} {prose(r, 100, 100_000)}" for _ in range(40)] + [f"{passage} {k}" for k in range(5)]
    texts += ["a b c d e", "a b c d f", "a b c", "A B C", "", None, "x " * 3000]
    return texts


def test_near_copies_of_long_texts_by_brute_force(spark):
    texts = near_copies()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for size, num, den in ((5, 80, 100), (3, 90, 100), (2, 50, 100)):
        of, sizes = components_by_force(texts, size, num, den)
        got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in jaccard.jaccard_components(frame, size, num, den).collect()}
        assert got == {k: (of[k], sizes[k]) for k in range(len(texts))}
        assert len(set(of)) < len(texts) - 40


def test_opened_tiles_in_blocks_find_the_same(spark, monkeypatch):
    texts = near_copies()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(jaccard, "TILE", 7)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(frame, 5, 80, 100).collect()}
    assert got == dict(enumerate(components_by_force(texts, 5, 80, 100)[0]))


def test_linked_sets_share_a_tile_and_others_hardly():
    """Tile keys alone: no linked pair is missed, and what meets by chance stays small."""
    r = np.random.default_rng(5)
    counts = np.ones(1 << jaccard.SKETCH_BITS, dtype=np.float32)
    common = np.sort(r.integers(0, 2**64, 12, dtype=np.uint64))
    counts[jaccard._slots(common)] = 1000
    for num, den in ((80, 100), (90, 100)):
        sets, pairs = [], []
        for n in (1, 2, 9, 40, 120, 150, 300, 900, 4000):
            for _ in range(30):
                x = np.unique(np.concatenate([r.integers(0, 2**64, n, dtype=np.uint64), common[:6]]))
                out = max(1, len(x) * (den - num) // (den + num))
                y = np.unique(np.concatenate([np.delete(x, r.choice(len(x), out // 2 + 1, replace=False)), r.integers(0, 2**64, out // 2, dtype=np.uint64)]))
                both = jaccard.overlap(x, y)
                if both * den >= num * (len(x) + len(y) - both):
                    pairs.append((len(sets), len(sets) + 1))
                sets += [x, y]
        keys, rows = jaccard.tile_keys(sets, counts, num, den)
        held = [set(keys[rows == k].tolist()) for k in range(len(sets))]
        assert len(pairs) > 100 and all(held[a] & held[b] for a, b in pairs)
        large = np.array([len(x) > 100 for x in sets])
        sizes = np.unique(keys[large[rows]], return_counts=True)[1]
        assert sizes.max() <= 8


def test_signatures_bound_from_above():
    r = np.random.default_rng(3)
    for n in (5, 300, 2000):
        x = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[n // 5 :], r.integers(0, 2**64, n // 3, dtype=np.uint64)]))
        a, b = jaccard.signature(x, 80, 100), jaccard.signature(y, 80, 100)
        width = min(len(a), len(b))
        differing = int(np.bitwise_count(jaccard._folded(a, width) ^ jaccard._folded(b, width)).sum())
        assert differing <= len(x) + len(y) - 2 * jaccard.overlap(x, y)


def test_keep_one_with_clashing_columns_and_repeated_rows(spark):
    text = prose(random.Random(1), 80)
    rows = [(1, text, "b"), (1, text, "a"), (2, text + " z", "c"), (3, "", "d"), (4, None, "e"), (None, text, "f"), (5, "one two", "g"), (5, "one two", "g")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, d string").withColumns({c: F.lit("x") for c in ("k", "_d", "_k", "row", "n_shingles", "is_first", "node")})
    out = jaccard.keep_one(frame)
    assert out.columns == frame.columns
    kept = sorted(((r["doc_id"], r["d"]) for r in out.collect()), key=str)
    first = min(("a", "b"), key=lambda d: frame.filter(F.col("d") == d).select(F.xxhash64(*frame.columns)).first()[0])
    assert kept == sorted([(1, first), (3, "d"), (4, "e"), (5, "g")], key=str)
    assert jaccard.keep_one(frame.limit(0)).count() == 0


def test_quality_rejects_more_than_the_base_rule_and_keeps_clean_texts(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=r.choice([1, 2, 3, 3, 4, 6, 8, 10])))
    clean = [" ".join(" ".join(word() for _ in range(r.randrange(7, 14))).capitalize() + "." for _ in range(r.randrange(8, 20))) for _ in range(300)]
    marked = [" ".join(w + r.choice(["###", "%%%", "&&&"]) for w in t.split()) for t in clean[:20]]
    listed = [" | ".join("".join(r.choices("abcdefgh", k=8)) for _ in range(90)) for _ in range(20)]
    texts = [*clean, *marked, *listed, "", None, "word " * 20]
    frame = spark.createDataFrame([*enumerate(texts), (None, clean[0]), (0, clean[0])], "doc_id long, text string").withColumn("n_words", F.lit("x"))
    got = quality.score(frame).collect()
    kept = {x["doc_id"]: x["kept"] for x in got}
    assert len(got) == len(texts) + 2 and all(kept[k] for k in range(300)) and kept[None]
    assert not any(kept[k] for k in range(300, len(texts)))
    failed = {x["doc_id"] for x in got if x["base_failed"]}
    assert not failed & set(range(300, 340)), "the method, not the base rule, rejects these"
    again = quality.keep_good(frame)
    assert again.columns == frame.columns and again.count() == 302


def test_license_ties_thresholds_and_several_licenses(spark):
    templates = spark.createDataFrame([("B", "one two three four five"), ("A", "One, two: three four five"), ("C", "six seven eight nine ten eleven"), ("D", "short"), ("E", None)], "license_id string, text string")
    texts = ["one two three four five", "six seven eight nine ten", "one two three four five.\nsix seven eight nine ten eleven", "six seven eight nine", "short", "", None, "x " * 20000 + "\none two three four five"]
    frame = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (0, texts[0])], "doc_id long, text string").withColumn("license_id", F.lit(1))
    got = {(x["doc_id"], x["license_id"]): (round(x["dice"], 4), x["n_passages"]) for x in licenses.scan(frame, templates).collect()}
    # of equal templates the smaller name counts; 4 of 5 bigrams are 8/9; 3 of 5 are 6/8, below the threshold
    assert got == {(0, "A"): (1.0, 1), (None, "A"): (1.0, 1), (1, "C"): (0.8889, 1), (2, "A"): (1.0, 1), (2, "C"): (1.0, 1), (7, "A"): (1.0, 1)}
    low = {(x["doc_id"], x["license_id"]) for x in licenses.scan(frame, templates, threshold=0.75).collect()}
    assert low - set(got) == {(3, "C")}
    assert licenses.scan(frame, templates.limit(0)).count() == 0 and licenses.scan(frame.limit(0), templates).count() == 0


def test_decontamination_refuses_clashing_slots(spark):
    item = "a farmer has 12 sheep and buys 30 more at the market then sells 12 of them and keeps 30 in the barn for the whole long winter"
    same = item.replace("12", "17").replace("30", "44")
    clash = item.replace("12 sheep", "17 sheep").replace("30 more", "44 more").replace("12 of", "18 of").replace("30 in", "45 in")
    frame = spark.createDataFrame([(1, same), (2, clash), (3, same), (3, same), (4, "y " * 30000 + same), (None, same), (5, ""), (6, None)], "doc_id long, text string").withColumns({c: F.lit(0) for c in ("d", "k", "_d", "item_id", "window", "tokens")})
    benchmark = spark.createDataFrame([(1, item), (1, item), (2, None), (None, item)], "item_id long, text string").withColumn("doc_id", F.lit(9))
    found = {x["doc_id"]: x["n_slots"] for x in decontaminate.contaminated(frame, benchmark).collect()}
    assert found == {1: 4, 3: 4, 4: 4, None: 4} or set(found) == {1, 3, 4, None}
    out = decontaminate.drop_contaminated(frame, benchmark)
    assert out.columns == frame.columns and sorted(x["doc_id"] for x in out.collect()) == [2, 5, 6]
    assert decontaminate.drop_contaminated(frame, benchmark.limit(0)).count() == frame.count()


def windows_by_force(text, item, size=8):
    """Share of an item's plain word windows that a text holds."""
    cut = lambda t: re.findall(r"[0-9A-Za-z]+", t.lower())
    w, i = cut(text), cut(item)
    held = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
    each = [tuple(i[k : k + size]) for k in range(len(i) - size + 1)]
    return sum(x in held for x in each) / len(each) if each else 0


def test_decontamination_of_plain_items_by_brute_force(spark):
    """Without numbers and names a template is its words: whole items, halves, fewer than halves, and texts that share words alone."""
    r = random.Random(8)
    items = [" ".join(f"v{r.randrange(60)}q" for _ in range(r.randrange(8, 40))) for _ in range(25)]
    texts = [prose(r, 50) for _ in range(20)]
    for item in items:
        w = item.split()
        cut = r.randrange(len(w))
        texts += [f"{prose(r, 9)} {item} {prose(r, 9)}", f"{prose(r, 9)} {' '.join(w[:cut])} {prose(r, 9)}", f"{' '.join(w[cut:])}, {' '.join(w[:cut])}", " ".join(r.sample(w, len(w)))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(frame, benchmark).collect()}
    assert got == {(d, i) for d, t in enumerate(texts) for i, item in enumerate(items) if windows_by_force(t, item) >= 0.5}
    assert len(got) >= 40


ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)"""


def base_by_force(text):
    """The base spans of the contract, from patterns written for this test."""
    found = [("assign", m.start(), m.end()) for m in re.finditer(ASSIGN, text) if len(m[1]) > 5]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) > 19]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) > 23]
    return sorted(found, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_base_secrets_by_brute_force(spark):
    r = random.Random(6)
    words = ["password", "PassWd:", "SECRET=", "token", "api_key", "apikey'", '"secret"', "=", ":", "= ", "AKIA", "hunter2hunter", "abc", "x1", "é", "ſecret", "Ketoken:", "Key", "0a1b" * 6, "0a1b" * 5, "AKIA" + "B2" * 8, "AKIA" + "B2" * 7, "\n", "\t", "'", '"', "token=", "a=b", "日本"]
    texts = ["".join(r.choice(words) + r.choice(["", "", " ", "  "]) for _ in range(r.randrange(0, 30))) for _ in range(400)] + ["", None, "é" * 50000 + "password=hunter2hunter"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit(1))
    field = secrets.fit(frame)
    for row in secrets.scan(frame, field).collect():
        base = base_by_force(texts[row["doc_id"]] or "")
        assert row["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest(), texts[row["doc_id"]]
        assert [row["n_assign"], row["n_access"], row["n_hex"]] == [sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex")]
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(row["spans"].split(",") if row["spans"] else [])


def test_field_finds_secrets_that_the_base_patterns_miss(spark):
    """Held-out generated lines, another seed than the fit's: only secrets that no base pattern touches count. Recall 0.8, precision 0.9 at least."""
    r = random.Random(77)
    lines = secrets.generated_lines(count=600, seed=4321)
    texts = [f"{prose(r, 30)}\n{line}\n{prose(r, 30)}" for line, _ in lines]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = spark.createDataFrame([(k, prose(r, 80)) for k in range(200)], "doc_id long, text string")
    field = secrets.fit(clean)
    found = {x["doc_id"]: [tuple(map(int, s.split(":")[1:])) for s in x["spans"].split(",") if s.startswith("crf")] for x in secrets.scan(frame, field).collect()}
    hit = missed = wrong = 0
    for k, (_, spans) in enumerate(lines):
        at = texts[k].index("\n") + 1
        base = [(s, e) for _, s, e in base_by_force(texts[k])]
        wanted = [(s + at, e + at) for s, e in spans if not any(a < e + at and s + at < b for a, b in base)]
        hit += sum(any(a < e and s < b for a, b in found[k]) for s, e in wanted)
        missed += sum(not any(a < e and s < b for a, b in found[k]) for s, e in wanted)
        wrong += sum(not any(a < e + at and s + at < b for s, e in spans) for a, b in found[k])
    assert hit + missed > 60
    assert hit / (hit + missed) >= 0.8 and hit / (hit + wrong) >= 0.9
    assert not [x for x in secrets.scan(clean, field).collect() if x["n_crf"]]


def service_keys(r):
    """Secrets in forms of real services, written here and not drawn from the generator that the field is trained on."""
    alnum, upper_hex = string.ascii_letters + string.digits, "0123456789ABCDEF"
    some = lambda chars, n: "".join(r.choices(chars, k=n))
    return {
        "glpat": lambda: "glpat-" + some(alnum + "_-", 20), "sg": lambda: f"SG.{some(alnum + '_-', 22)}.{some(alnum + '_-', 43)}", "sk": lambda: "SK" + some(upper_hex, 32), "npm": lambda: "npm_" + some(alnum, 36), "aiza": lambda: "AIza" + some(alnum + "_-", 35),
        "hf": lambda: "hf_" + some(alnum, 34), "dop": lambda: "dop_v1_" + some(upper_hex.lower(), 64), "shpat": lambda: "shpat_" + some(upper_hex.lower(), 32), "ghp": lambda: "ghp_" + some(alnum, 36), "cloud": lambda: some(alnum + "+/", 40),
        "url": lambda: f"postgres://user:{some(alnum, 18)}@db.example.com/x", "hook": lambda: f"https://hooks.example.com/services/T{some(alnum[26:], 8)}/B{some(alnum[26:], 8)}/{some(alnum, 24)}",
    }


def test_field_finds_keys_of_services_and_leaves_look_alikes(spark):
    """Twelve forms, 30 documents each: 0.9 of all are found, half at least of each form; of ids, names, sequences, paths and calls none is marked."""
    r = random.Random(5)
    some = lambda chars, n: "".join(r.choices(chars, k=n))
    low, lines = string.ascii_lowercase, ["{v}", "use {v}", 'export X="{v}"', "{v},", "config: {v}"]
    keys = [(name, f"{prose(r, 20)}\n{r.choice(lines).format(v=make())}\n{prose(r, 20)}") for name, make in service_keys(r).items() for _ in range(30)]
    like = [str(uuid.UUID(int=r.getrandbits(128))) for _ in range(40)] + ["".join(some(low, 8).capitalize() for _ in range(3)) for _ in range(40)] + [some("ACGT", 50) for _ in range(40)] + [f"978-3-16-148410-{k}" for k in range(10)]
    like += [f"https://example.com/a/b/{some(low, 12)}?id={k}" for k in range(40)] + ["-".join(some(low, k) for k in (5, 7, 6)) for _ in range(40)] + [f"{some(low, 5)}_{some(low, 12)}_{k:04d}" for k in range(40)] + [f"{some(low, 6)}.{some(low, 12)}.{some(low, 15)}()" for _ in range(40)]
    field = secrets.fit(spark.createDataFrame([(k, prose(r, 80)) for k in range(200)], "doc_id long, text string"))
    texts = [t for _, t in keys] + [f"{prose(r, 15)} {x} {prose(r, 15)}" for x in like]
    marked = {x["doc_id"]: x["spans"].split("\n")[0] for x in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), field).collect()}
    found = Counter()
    for k, (name, text) in enumerate(keys):
        a, b = text.index("\n"), text.rindex("\n")
        found[name] += any(a < int(s.split(":")[1]) < b for s in marked[k].split(",") if s)
    assert sum(found.values()) >= 0.9 * len(keys) and min(found[n] for n in service_keys(r)) >= 15, found
    wrong = [like[k - len(keys)] for k in range(len(keys), len(texts)) if "crf" in marked[k]]
    assert not wrong, wrong[:5]


def test_special_tokens_and_other_vocabularies():
    texts = ["a <|ENDOFTEXT|> b", "x<|endoftext|>Y z", "<|StartOfText|>", "Hello WORLD. ok", "", None, "ΑΣ. don't «q»", "a　b c d", "ab.!? cd..", "!!?? a"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encoder = tokens.PieceEncoder(public_tokenizers.path(name))
        ids, bounds = encoder.encode(pa.array(texts))
        for k, t in enumerate(texts):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == [*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, tokens.END_ID]


def test_positions_out_of_range(spark, tmp_path):
    r = random.Random(3)
    frame = spark.createDataFrame([(k, prose(r, 40)) for k in range(30)], "doc_id long, text string").withColumn("start", F.lit(1))
    dac.write_tokens(frame, f"{tmp_path}/t", VOCABULARY)
    every = [i for x in dac.read_documents(spark, f"{tmp_path}/t").orderBy("start").collect() for i in x["ids"]]
    asked = [0, 0, 5, len(every) - 1, len(every), -1, None, 10**12]
    got = sorted(((x["position"], x["id"]) for x in dac.read_tokens(spark, f"{tmp_path}/t", spark.createDataFrame([(p,) for p in asked], "position long")).collect()), key=str)
    assert got == sorted(((p, every[p] if p is not None and 0 <= p < len(every) else None) for p in asked), key=str)


def test_shards_on_disk_and_clashing_columns(spark, tmp_path):
    names = ["a", "b", "c"]
    frame = spark.createDataFrame([(k, "t", "x", "y") for k in range(60)] + [(None, None, None, None), (7, "t", "x", "y")], "doc_id long, slot_ string, shard_ string, _slot string").withColumn("_shard", F.lit(5)).withColumn("shard", F.lit(9))
    placed = sharding.place(frame, names, size=31)
    assert set(placed.columns) == {*frame.columns, "slot"} and placed.count() == 62
    table = sharding.build_table(names, 31)
    for x in placed.collect():
        assert x["shard"] == table[int(hashlib.md5(str("" if x["doc_id"] is None else x["doc_id"]).encode()).hexdigest()[:8], 16) % 31]
    sharding.write_shards(frame, f"{tmp_path}/s", names)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.count() == 62 and {x["shard"] for x in back.select("shard").distinct().collect()} <= {0, 1, 2}


def test_packing_at_its_length(spark):
    r = random.Random(12)
    rows = [(k, prose(r, r.randrange(1, 6000))) for k in range(40)] + [(None, None), (3, "again"), (50, "")]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("x")).repartition(2), VOCABULARY).collect()
    by_sequence = {}
    for x in out:
        assert x["ids_crc32"] == zlib.crc32(np.array(x["ids"], dtype="<u4").tobytes()) and x["length"] == len(x["ids"])
        by_sequence.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    ends = []
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        ends.append(at)
    assert max(ends) == packing.SEQUENCE and all(n == packing.SEQUENCE or n & (n - 1) == 0 for n in ends)


def test_toxicity_of_repeated_and_long_rows(spark):
    r = random.Random(4)
    table = [(k, prose(r, 100) + (" vilesort nastyword badthing" * 2 if k % 3 == 0 else "")) for k in range(240)]
    long = prose(r, 30000) + " vilesort nastyword badthing" * 900
    frame = spark.createDataFrame([*table, *table[:5], (900, long), (None, table[0][1])], "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(240)] + [(3, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.score(frame, labels).collect()
    assert len(got) == frame.count()
    for k in range(5):
        assert len({x["score"] for x in got if x["doc_id"] == k}) == 1
    assert [x["predicted"] for x in got if x["doc_id"] == 900] == [1]
