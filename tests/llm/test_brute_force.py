"""Whole results against plain versions on a small table."""

import collections
import random
import re
import struct
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from shapeloom.llm import decontaminate, languages, licenses, near_dup, packing, registry, shingles, substring_dedup, token_files, tokens, toxicity, workspace
from shapeloom.llm.components import components

SF = "/root/testdata/sf0.001"
WORDS, BYTES = tokens.default_path("word_bpe_49k.json"), tokens.default_path("byte_bpe_50k.json")


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


@pytest.mark.parametrize("seed", range(3))
def test_cached_pieces_give_the_librarys_ids(seed):
    words, counts = tokens.WordIds(WORDS), tokens.ByteCounts(BYTES)
    plain_words, plain_bytes = Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES)
    assert words.merges and counts.merges
    parts = [" ", "  ", "   ", "\n", "\n\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "　", "a", "The", "don't", "'s", "é", "é", "́", "Σ", "123", "?!", "<|endoftext|>", "<|end", "😀", "日本", "ß", "İ", "\x00"]
    rng = random.Random(seed)
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 9)))
        assert words.ids(text) == packed(plain_words.encode(text, add_special_tokens=False).ids), text
        assert counts.count(text) == len(plain_bytes.encode(text, add_special_tokens=False).ids), text


def test_packing(spark, small):
    docs = small.toPandas()
    tokenizer = Tokenizer.from_file(WORDS)
    coded = [e.ids + [1] for e in tokenizer.encode_batch(docs["text"].fillna("").tolist(), add_special_tokens=False)]
    ids = dict(zip(docs["doc_id"], coded, strict=True))
    rows = packing.pack(small, WORDS).toPandas()
    for r in rows.itertuples():
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert (len(piece), zlib.crc32(packed(piece)), 4096 * r.piece) == (r.length, r.ids_crc32, r.start)
    assert rows["length"].sum() == sum(map(len, coded))
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *np.cumsum(s["length"])[:-1]] and s["length"].sum() <= 4096


def test_token_counts_of_the_whole_table(spark, small):
    docs = {r["doc_id"]: r["text"] or "" for r in small.collect()}
    tokenizer = Tokenizer.from_file(BYTES)
    want = {i: (len(t.encode()), n := len(tokenizer.encode(t, add_special_tokens=False).ids), n > 512) for i, t in docs.items()}
    got = registry.QUERIES["op5_token_counts"](spark, SF).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got} == want and len(got) == len(docs)


def test_token_files_of_the_whole_table(spark, small):
    tokenizer, start, want = Tokenizer.from_file(WORDS), 0, {}
    for r in sorted(small.collect(), key=lambda r: r["doc_id"]):
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        want[r["doc_id"]] = (start, len(ids), zlib.crc32(packed(ids)))
        start += len(ids)
    got = registry.QUERIES["op7_token_files"](spark, SF).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("by", ["byte", "bit"])
def test_single_documents_are_read_by_the_index(spark, small, by):
    path = workspace.fresh_path(spark, "test-files")
    token_files.write_ids(small, WORDS, path, block=500, chunk_ids=4000, by=by)
    tokenizer = Tokenizer.from_file(WORDS)
    wanted = small.where("doc_id % 7 = 3")
    want = {r["doc_id"]: tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2] for r in wanted.collect()}
    assert {r["doc_id"]: r["ids"] for r in token_files.read_documents(spark, path, wanted).collect()} == want


def test_languages_that_contain_a_gram():
    """No language that has a gram is left out, and letters are those of Unicode."""
    model, grams = languages.LanguageFilter([f"l{i}" for i in range(70)]), np.arange(1, 4000, dtype=np.uint32)
    for i in range(70):
        model.add(i, grams[grams % (i + 2) == 0])
    model.seal()
    for g in grams[::97]:
        counts = model.counts(np.array([g]), np.array([0]), 1)[0]
        assert all(counts[i] > 0 for i in range(70) if g % (i + 2) == 0)
    for text, yes in (("½ ² Ⅷ 12 _ -", False), ("", False), ("½a", True), ("1ß", True), ("日", True), ("\u0301", False), ("😀", False)):
        assert languages.has_letter(text) is yes, text


def test_a_rare_language_is_learned(spark):
    words = {"aa": "haus baum hund", "bb": "casa arbol perro", "cc": "xyqz wvku zzyx"}
    rows = [(i, " ".join([words[lang]] * 4), lang) for i in range(300) for lang in [("cc" if i == 77 else "aa" if i % 3 else "bb")]]
    model = languages.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train_docs=60)
    got = languages.predict(spark.createDataFrame([(1, "zzyx wvku"), (2, "hund baum"), (3, "perro")], "doc_id long, text string"), model)
    assert [r["lang_pred"] for r in sorted(got.collect())] == ["cc", "aa", "bb"]


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_best_fit_decreasing(seed):
    import bisect

    rng = random.Random(seed)
    lengths = [rng.randint(1, 60) for _ in range(400)]
    runs, n = packing.plan(collections.Counter(lengths), 100)
    rooms = []
    for length in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rooms, length)
        bisect.insort(rooms, (rooms.pop(k) if k < len(rooms) else 100) - length)
    assert n == len(rooms) and sum(1 for _ in runs) <= len(lengths)


@pytest.mark.parametrize("by", ["byte", "bit"])
def test_planes_round_trip(by):
    for n in (0, 1, 7, 5000):
        ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
        assert (token_files.decode_chunk(token_files.encode_chunk(ids, 1024, by), n, 1024) == ids).all()


def plain_near_copies(rows):
    """(doc_id, text) -> (n_shingles, component_id), by holding all texts against each other."""
    sets = {}
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        sets[doc, text] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())
    up = {x: x for x in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = list(sets)
    for k, x in enumerate(keys):
        for y in keys[:k]:
            both = len(sets[x] & sets[y])
            if both and 100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both):
                up[root(x)] = root(y)
    least = {}
    for doc, text in keys:
        r = root((doc, text))
        least[r] = min(least.get(r, doc), doc)
    return {x: (len(s), least[root(x)]) for x, s in sets.items()}


def near_copies_of(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dup.group_near_copies(docs).collect())


def test_near_copies(small):
    rows = [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.group_near_copies(small).collect()}
    assert got == {doc: x for (doc, _), x in plain_near_copies(rows).items()}


def test_near_copies_of_a_hot_group(spark):
    """Many versions of one text, some too far from all others, and chains that hang together by one link only."""
    rng, words = random.Random(5), [f"w{i}" for i in range(400)]
    base, rows = rng.choices(words, k=120), []
    for i in range(260):
        text = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 5, 6])):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text)))
    for i in range(260, 300):  # each takes over five words more
        text = base[:]
        text[: 3 * (i - 260)] = [f"c{k}" for k in range(3 * (i - 260))]
        rows.append((i, " ".join(text)))
    rng.shuffle(rows)
    want = plain_near_copies(rows)
    assert len({c for _, c in want.values()}) > 10
    assert near_copies_of(spark, rows) == sorted((doc, *x) for (doc, _), x in want.items())


def test_near_copies_with_repeated_and_null_ids(spark):
    """A row has the component of its own text, whatever other texts its id has."""
    text = [" ".join(f"{c}{k}" for k in range(60)) for c in "abc"]
    rows = [(1, text[0]), (1, text[1]), (3, text[1] + " tail"), (2, text[0] + " tail"), (7, text[2]), (7, text[2]), (None, text[2])]
    got = near_dup.group_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r["doc_id"], r["component_id"], r["kept"]) for r in got) == {(1, 1, True): 2, (3, 1, False): 1, (2, 1, False): 1, (7, 7, True): 2, (None, 7, False): 1}
    docs = spark.createDataFrame([(*r, "x", i) for i, r in enumerate(rows)], "doc_id long, text string, row_key string, node int")
    assert sorted((r["doc_id"], r["text"]) for r in near_dup.keep_one(docs).collect()) == [(1, text[0]), (1, text[1]), (7, text[2])]


def test_floor_is_that_of_the_estimate():
    rng = np.random.default_rng(1)
    one, n = [], []
    pool = rng.integers(0, 2**63, 900, dtype=np.uint64)
    for k in range(60):
        one.append(near_dup.registers(pool[k * 8 : k * 8 + 300]))
        n.append(300.0)
    one, n = np.array(one), np.array(n)
    a, b = np.triu_indices(60, 1)
    j = near_dup.estimate(one[a], one[b], n[a], n[b])
    clear = abs(j - near_dup.FLOOR) > 1e-4
    assert (near_dup.reaches(one[a], one[b], n[a], n[b])[clear] == (j >= near_dup.FLOOR)[clear]).all() and 100 < (j >= near_dup.FLOOR).sum() < 1600


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = pool[:2000], pool[500:2500]
    one, other = near_dup.registers(a), near_dup.registers(b)
    assert (near_dup.merge(one, other) == near_dup.registers(pool[:2500])).all()
    (j,) = near_dup.estimate(one[None], other[None], np.array([2000.0]), np.array([2000.0]))
    assert abs(j - 0.6) < 0.16


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 130)] + [(5, 9), (9, 7), (1, 1)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {5: 5, 7: 5, 9: 5} | {i: 100 for i in range(100, 131)}


def test_shingle_hashes_are_those_of_the_words():
    texts = [b"a b c d e f", b"", b" a  b\tc d\ne f ", b"f e d c b a", b"a b"]
    one, empty, same, turned, short = shingles.shingle_sets(texts)
    assert (one == same).all() and len(one) == 2 and not set(one) & set(turned) and len(empty) == 0 and len(short) == 1


def plain_repeats(rows, window):
    """doc_id -> kept words, from all windows of all texts."""
    words = {doc: re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()) for doc, text in rows}
    seen, gone = set(), set()
    for doc in sorted(words):
        for i in range(len(words[doc]) - window + 1):
            key = tuple(words[doc][i : i + window])
            if key in seen:
                gone.update((doc, i + j) for j in range(window))
            seen.add(key)
    return {doc: [w for i, w in enumerate(ws) if (doc, i) not in gone] for doc, ws in words.items()}


@pytest.mark.parametrize("cells", [8, 1, 1e-9])
def test_repeated_windows(spark, monkeypatch, cells):
    """Sketches with too few cells only let more windows through; units and slices do not show."""
    rng, words = random.Random(2), [f"w{i}" for i in range(500)]
    passages = [rng.choices(words, k=rng.randint(15, 90)) for _ in range(12)]
    rows = [(i * 3 % 101, " ".join(sum((rng.choice([rng.choice(passages), rng.choices(words, k=rng.randint(0, 40))]) for _ in range(4)), []))) for i in range(100)]
    rows += [(900, "a " * 300), (901, None), (902, ""), (903, " ".join(words[:20])), (899, "b c " * 50)]
    monkeypatch.setattr(substring_dedup, "UNIT_BYTES", 3000)
    monkeypatch.setattr(substring_dedup, "SLICE_WORDS", 700)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, unit int").repartition(7)
    got = {r["doc_id"]: r["kept_text"] for r in substring_dedup.remove_repeats(docs, cells=cells).collect()}
    assert got == {doc: b" ".join(ws).decode() for doc, ws in plain_repeats(rows, 20).items()}


def test_partial_sketches_merge_and_never_underestimate():
    rng, width = np.random.default_rng(4), 64
    parts = [np.unique(rng.integers(0, 300, 40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(6)]
    sketch = substring_dedup.CountMin(width)
    partials = [substring_dedup.CountMin.partial(p, np.ones(len(p)), width) for p in parts]
    for p in partials:
        sketch.merge(p)
    counts = collections.Counter(x for p in parts for x in p.tolist())
    for part, partial in zip(parts, partials, strict=True):
        rows = zip(sketch.repeated(partial), partial, substring_dedup.CountMin.places(part, width), strict=True)
        flags = np.all([f[np.searchsorted(cells, at)] for f, (cells, _), at in rows], axis=0)
        assert all(f for f, x in zip(flags, part.tolist(), strict=True) if counts[x] > 1)


def test_two_polynomials_are_independent():
    texts = [f"a{i} b{i * 7 % 13} c".encode() for i in range(50)]
    one, other = shingles.Words(texts), shingles.Words(texts, family=1)
    assert not set(one.hash.tolist()) & set(other.hash.tolist()) and len(set(one.hash.tolist())) == len(set(other.hash.tolist()))


def test_leaks_survive_substitutions(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"
    swapped = item.split()
    swapped[3], swapped[9] = "other", "words"
    docs = [(1, f"before {item.upper()} after"), (2, "x " + " ".join(swapped) + " y"), (3, " ".join(item.split()[:6]) + " and then nothing of it any more at all"), (4, "clean")]
    found = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == [(1, 7), (2, 7)]


def plain_overlaps(docs, items):
    """(doc_id, item_id) of all texts with a stretch of enough equal words, by laying every item over every place."""
    out = set()
    for doc, text in docs:
        words = (text or "").lower().split()
        for item, passage in items:
            own = (passage or "").lower().split()
            need = min(13, len(own))
            least = 0.8 * need if len(own) >= 6 else need
            if any(sum(a == b for a, b in zip(words[p : p + need], own[i : i + need], strict=True)) >= least for i in range(len(own) - need + 1) if need for p in range(len(words) - need + 1)):
                out.add((doc, item))
    return out


def leak_cases(rng):
    """Texts that hold items, whole or in part, with substituted words; items of all lengths; repetitive ones; nulls."""
    words = [f"w{i}" for i in range(300)]
    items = [(None if n == 9 else n, " ".join(rng.choices(words, k=n))) for n in range(1, 41)]
    items += [(100, "a " * 30), (101, "b c " * 12), (102, None), (103, ""), (104, items[20][1]), (105, "日本語 の 試験")]
    docs = [(900, "a " * 200), (901, "c b " * 90), (902, None), (903, ""), (904, "x 日本語の試験 y"), (905, items[3][1]), (None, items[30][1])]
    for i in range(200):
        own = rng.choice(items)[1] or ""
        own = own.split()[rng.choice([0, 0, 3]) :][: rng.choice([50, 50, 12, 14])]
        for _ in range(rng.choice([0, 1, 2, 3])):
            if own:
                own[rng.randrange(len(own))] = rng.choice(words)
        docs.append((i, " ".join(rng.choices(words, k=rng.choice([0, 1, 9])) + own + rng.choices(words, k=rng.choice([0, 1, 9])))))
    return docs, items


def test_leaks_against_all_places(spark, monkeypatch):
    docs, items = leak_cases(random.Random(11))
    want = plain_overlaps(docs, items)
    assert {i for _, i in want} >= {1, 2, 4, 6, 7, 8, 100, 101} and any(i and 12 < i < 100 for _, i in want) and {d for d, _ in want} >= {900, 901, 905}
    table = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, ref string, place long").repartition(5)
    bench = spark.createDataFrame(items, "item_id long, text string")
    small = decontaminate.overlaps(table, bench).collect()
    kept = sorted((r["doc_id"] or -1, r["text"] or "") for r in decontaminate.clean(table, bench).collect())
    found = {(r["doc_id"], r["item_id"]) for r in small}
    assert found - {(904, 105)} == want and (904, 105) in found
    assert kept == sorted((d or -1, t or "") for d, t in docs if d not in {x for x, _ in found})
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(decontaminate.overlaps(table, bench).collect(), key=key) == sorted(small, key=key)
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in decontaminate.clean(table, bench).collect()) == kept


def test_every_stretch_with_enough_equal_words_has_a_hit():
    """All ways to substitute words of a stretch, against the masks that serve it."""
    from itertools import combinations

    for n in range(1, 14):
        allowed = int(n - 0.8 * n + 1e-9) if n >= decontaminate.TOLERANT else 0
        masks = [m for m, least, most in decontaminate.MASKS if least <= n <= most]
        for gone in combinations(range(n), allowed):
            assert any(all(m[j] == "0" or p + j not in gone for j in range(len(m))) for m in masks for p in range(n - len(m) + 1)), (n, gone)


def test_licenses(messy):
    got = {r["doc_id"]: r for r in licenses.scan(messy).collect()}
    for i, text in [(r["doc_id"], r["text"] or "") for r in messy.collect()]:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(licenses._UPPER, licenses._LOWER)))
        places = [(j, label) for phrase, label in licenses.BASE for p in [phrase.split()] for j in range(len(words)) if words[j : j + len(p)] == p]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(places), ",".join(sorted({x for _, x in places})))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        line = f" {' '.join(words)} "
        hits = sorted((m.start(), -m.end(), -x["priority"], x["label"]) for x in licenses.rules() if any(k in line for k in x["keywords"]) for m in re.finditer(x["regex"], line))
        kept = [h for k, h in enumerate(hits) if not any(g[0] <= h[0] and g[1] <= h[1] and g[2] <= h[2] for g in hits[:k])]
        assert r["labels"] == ",".join(sorted({h[3] for h in kept} | {x for _, x in places}))


def test_every_rule_has_its_keywords_and_gates():
    """What a rule's regex matches has its keywords, and a text with it gets through the gates."""
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    gate = re.compile("|".join(g.replace(" ", licenses._GAP_ANY_CASE) for g in licenses.GATES), re.IGNORECASE)

    def holds(rule):
        body = rule["regex"].removeprefix("(?<= )").removesuffix("(?= )").replace("[^ ]", "[a-z0-9]").replace("(?!(?:or|and) (?!later ))", "").replace("(?!later )", "")

        @settings(max_examples=3, deadline=None, database=None, suppress_health_check=list(HealthCheck))
        @given(st.from_regex(body, fullmatch=True))
        def check(match):
            line = f" {match} "
            if re.search(rule["regex"], line):
                assert any(k in line for k in rule["keywords"]) and rule["also"] in line, rule
                assert gate.search(line) and any(w in line for w in licenses.GATE_WORDS), rule

        check()

    for rule in licenses.rules():
        holds(rule)


def test_automaton_finds_all_terms_within_one_edit():
    terms = ["idiot", "moron", "trash"]
    fuzzy, rng = toxicity.FuzzyLexicon(terms), random.Random(0)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    for _ in range(2000):
        word = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randint(0, 1)] = rng.choices("idmort", k=rng.randint(0, 1))
        word = "".join(word)
        assert fuzzy.search(word) == {t: d for t in terms if (d := distance(word, t)) <= 1}


def test_license_identifiers_short_names_and_bodies(spark):
    cases = {
        "SPDX-License-Identifier: MIT": "mit",
        "# SPDX-License-Identifier: Apache-2.0": "apache-2.0",
        "SPDX-License-Identifier: ISC": "isc",
        "SPDX-License-Identifier: Zlib": "zlib",
        "SPDX-License-Identifier: Artistic-2.0": "artistic-2.0",
        "SPDX-License-Identifier: OFL-1.1": "ofl-1.1",
        "SPDX-License-Identifier: BSL-1.0": "bsl-1.0",
        "SPDX-License-Identifier: MIT-0": "mit-0",
        "SPDX-License-Identifier: (MIT OR Apache-2.0 OR ISC)": "apache-2.0,isc,mit",
        "Licensed under Apache 2.0": "apache-2.0",
        "This is licensed under the MIT": "mit",
        "distributed under the terms of the ISC": "isc",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided": "bsd",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products": "bsd-3-clause",
        "you may not use this file except in compliance with the License. You may obtain a copy of": "apache",
        "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended": "gpl",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY": "lgpl",
        "CC Attribution 4.0": "cc-by-4.0",
        "We sat under the tree with the mit of it": "",
        "Redistribution of seats is free of charge": "",
    }
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(docs).collect()}
    assert {t: got[i] for i, t in enumerate(cases)} == cases
