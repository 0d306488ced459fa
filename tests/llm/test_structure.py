"""Conversation repair, collocations and SimHash near copies against plain versions, and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from terrier.llm import collocations, conversation_repair, simhash_dedup

# --- conversations

TURNS = "conv_id long, turn long, role string, text string, copies long, digest string, edits string"
WS = " \t\n\x0b\x0c\r"


def damaged(rows):
    def said(x):
        return " " if x is None else str(x)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        for _ in range({0: 0, 3: 2}.get(kind, 1)):
            yield conv, turn, role, text


def cheapest(symbols):
    """Least cost and edits of (initial, gone, cut) rows, by trying every edit at every place."""
    steps = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @cache
    def best(i, state, budget):
        found = []
        if i == len(symbols) and state in ("", "a"):
            found.append((0, ""))
        if budget:
            for role in "ua":
                if role in steps[state]:
                    cost, edits = best(i, role, budget - 1)
                    found.append((cost + 3, "I" + edits))
        if i < len(symbols):
            initial, gone, cut = symbols[i]
            cost, edits = best(i + 1, state, 3)
            found.append((cost + 4, "D" + edits))
            if not gone:
                if initial in steps[state]:
                    cost, edits = best(i + 1, steps[state][initial], 3)
                    found.append((cost + 3 * cut, "K" + edits))
                for role in "ua":
                    if role in steps[state]:
                        cost, edits = best(i + 1, role, 3)
                        found.append((cost + 3 + 3 * cut, "R" + edits))
        return min(found, default=(10 ** 9, ""))

    for i in range(len(symbols), -1, -1):  # keeps the recursion short
        for state in steps:
            best(i, state, 3)
    return best(0, "", 3)


def report(rows):
    by = defaultdict(list)
    for row in rows:
        by[row[0]]
    for row in damaged(rows):
        by[row[0]].append(row[1:])
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.md5(r[2].encode()).digest()))
        seen, symbols, faults = set(), [], Counter()
        for turn, role, text in turns:
            body = text.rstrip(WS)
            blank, again = not body, (role, text) in seen
            cut = bool(body) and body[-1] not in ".!?"
            faults["blank" if blank else "duplicate" if again else "truncated" if cut else "none"] += 1
            seen.add((role, text))
            symbols.append((role[:1], blank or again, cut))
        numbers = [t[0] for t in turns if t[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(x[0] + y[0] not in ("su", "ua", "au") for x, y in zip(symbols, symbols[1:]))
        cost, audit = cheapest(tuple(symbols))
        kept, at, initials = [], 0, ""
        for edit in audit:
            want = "assistant" if initials.endswith("u") else "user"
            if edit == "K":
                kept.append(f"{turns[at][1]}:{turns[at][2]}")
                initials += turns[at][1][0]
            elif edit in "RI":
                kept.append(f"{want}:{turns[at][2] if edit == 'R' else ''}")
                initials += want[0]
            at += edit != "I"
        assert re.fullmatch("(s?(ua)+)?", initials) and at == len(turns)
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest)
    return out


def conversation_rows(seed=5):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "so what? ", " \t", "", None, "Ärger.\n", "x" * 90 + ".", "x" * 90 + "?"]
    roles = ["user", "assistant", "system", "tool", None, "", "user", "assistant"]
    rows = [(conv, turn, rng.choice(roles), rng.choice(texts)) for conv in range(150) for turn in range(rng.randrange(1, 9))]
    rows += [(None, t, rng.choice(roles), rng.choice(texts)) for t in range(5)]
    rows += [(1000, None if t % 5 == 0 else t // 2 * 3, rng.choice(roles), rng.choice(texts)) for t in range(60)]
    rows += [(2000, t, ("user", "assistant")[(t + t // 700) % 2], f"turn {t}{'.' if t % 13 else ''}") for t in range(2600)]
    rows += [(3000, 7, "user", "same.")] * 1500
    rows += [(c, 0, "user", "x.") for c in range(4000, 4040)]  # some lose all rows
    rng.shuffle(rows)
    return rows


def conversations(spark, rows):
    return spark.createDataFrame([(*r, None, None, None) for r in rows], TURNS)


def test_repair_equals_trying_every_edit(spark):
    rows = conversation_rows()
    table = conversations(spark, rows).repartition(5)
    turns = conversation_repair.damage(table)
    want = report(rows)
    got = conversation_repair.repair_report(table, turns).collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id
    assert any(not w[6] for w in want.values())
    lines = defaultdict(list)
    for r in sorted(conversation_repair.repair(turns).collect(), key=lambda r: (r.conv_id or -1, r.place)):
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    for conv, row in want.items():
        assert hashlib.sha256("\n".join(lines[conv]).encode()).hexdigest() == row[-1]


def test_repair_of_empty_and_null_tables(spark):
    none = conversations(spark, [])
    assert conversation_repair.repair_report(none, conversation_repair.damage(none)).count() == 0
    assert conversation_repair.repair(none).count() == 0
    nulls = conversations(spark, [(None, None, None, None)])
    rows = [(None, None, None, None)]
    assert [tuple(r)[1:] for r in conversation_repair.repair_report(nulls, conversation_repair.damage(nulls)).collect()] == [report(rows)[None]]
    named = nulls.withColumn("conv_id", F.lit("é"))
    assert conversation_repair.repair_report(named, conversation_repair.damage(named)).first().conv_id == "é"


def test_equal_ends_are_one_node():
    made = []

    def node(letter, rest):
        made.append(letter + rest)
        return letter + rest
    signatures = sorted(["uaua", "saua", "ua", "xua", "uaxua", "uAua"], key=lambda s: s[::-1])
    assert list(conversation_repair._shared(signatures, node, "")) == signatures
    assert len(made) == len(set(made)) == len({s[i:] for s in signatures for i in range(len(s))})


# --- collocations

DOCS = "doc_id long, text string, lang string, source string, n long, phrase string, a long, rank int, score double"


def documents(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None, None) for r in rows], DOCS)


def plain_collocations(rows, top):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for m in range(1, 5):
                counts[lang].update(tuple(words[i: i + m]) for i in range(len(words) - m + 1))
    out = set()
    for lang, found in counts.items():
        often = {p: n for p, n in found.items() if n >= 30}
        kept = []
        for p, a in often.items():
            if len(p) == 1:
                continue
            score, k = min((2000000 * a // (often[p[:k]] + often[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * n >= 80 * a and any(q[i: i + len(p)] == p for i in range(len(q)))
                         for q, n in often.items())
            if not inside:
                kept.append((-score, -a, " ".join(p).encode(), often[p[:k]], often[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return out


def phrase_rows(seed=2):
    rng = random.Random(seed)
    words = ["new", "york", "city", "Hall", "é", "the", "of", "a\x01b", "ß", "x y", "rare", "\x0b"]
    weights = [9, 9, 6, 6, 3, 12, 8, 2, 2, 2, .3, 1]
    rows = []
    for i in range(900):
        picked = rng.choices(words, weights, k=rng.randrange(0, 25))
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n"]) for w in picked)
        if i % 3 == 0:
            text += " New york city hall. of the new york city"
        rows.append((i, text, rng.choice(["en", "de", None, "und"]), None))
    return [*rows, rows[0], (None, None, "en", None), (5, "", None, None), (6, " .,\t", "xx", None)]


@pytest.mark.parametrize("budget", [1 << 20, 40])
def test_phrase_counts_whatever_the_groups(spark, budget):
    rows = phrase_rows()
    got, totals = collocations.phrase_counts(documents(spark, rows), budget=budget)
    want = defaultdict(Counter)
    for _, text, lang, _ in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").lower()):
            words = re.findall("[^ \t]+", piece)
            for m in range(1, 5):
                want[lang or "und"].update(" ".join(words[i: i + m]) for i in range(len(words) - m + 1))
    assert {tuple(r) for r in got.collect()} == {(g, p, n) for g, c in want.items() for p, n in c.items() if n >= 30}
    assert len(got.collect()) == got.distinct().count()


def test_collocations_equal_plain_ones(spark):
    rows = phrase_rows()
    for top in (2000, 5):
        got = collocations.collocations(documents(spark, rows), top=top).collect()
        want = plain_collocations(rows, top)
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert collocations.collocations(documents(spark, [])).count() == 0
    assert collocations.collocations(documents(spark, [(1, None, None, None)])).count() == 0


def test_a_subtree_counts_every_prefix():
    rng = random.Random(4)
    leaves = Counter((rng.choice(["en", "de"]), " ".join(rng.choices("ab", k=3)), rng.choice(["x", "y", "z", None])) for _ in range(2000))
    rows = [(*leaf, n - n // 2) for leaf, n in leaves.items()] + [(*leaf, n // 2) for leaf, n in leaves.items()]
    table = pa.table([pa.array(c) for c in zip(*rows)], names=["lang", "head", "tail", "n"])
    want = Counter()
    for (lang, head, tail), n in leaves.items():
        want[lang, head] += n
        if tail:
            want[lang, f"{head} {tail}"] += n
    got = collocations._subtree(table).to_pylist()
    assert {(r["lang"], r["phrase"]): r["n"] for r in got} == {k: n for k, n in want.items() if n >= 30}
    assert any(n < 30 for n in want.values())


def test_a_large_prefix_has_groups_of_its_own(spark):
    pairs = spark.createDataFrame([("en", f"w{i} x", 30 + i % 7) for i in range(300)] + [("en", "of the", 5000)],
                                  "lang string, phrase string, n long")
    groups = collocations.Groups(pairs, 1000)
    hashes = {p: xxhash.xxh64_intdigest(p, xxhash.xxh64_intdigest("en", 42)) for p in [f"w{i} x" for i in range(300)]}
    load = Counter()
    for i, h in enumerate(hashes.values()):
        load[int(groups.of(np.array([h], np.uint64))[0])] += 30 + i % 7
    assert max(load.values()) <= 1000 and len(load) > 5
    (first, parts), = groups.split.values()
    assert parts >= 5 and first > max(load) and groups.number >= first + parts


# --- SimHash

def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    width = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i: i + width]), 42) for i in range(len(words) - width + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v
    for i, x in enumerate(values):
        for y in values[i + 1:]:
            if (x ^ y).bit_count() <= 2:
                parent[root(x)] = root(y)
    return {v: root(v) for v in values}


def crowded_values(seed=8):
    """Bits far apart, chains of near ones, and a crowd that differs in few places."""
    rng = random.Random(seed)
    values = {rng.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1}
    for start in list(values)[:40]:
        for _ in range(rng.randrange(1, 6)):
            start ^= 1 << rng.randrange(64) ^ (1 << rng.randrange(64))
            values.add(start & (1 << 64) - 1)
    centre = rng.getrandbits(64)
    values |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))) for _ in range(250)}
    return sorted(values)


@pytest.mark.parametrize("shard", [8, 64, simhash_dedup.SHARD])
def test_tree_links_lose_no_component(spark, shard):
    values = crowded_values()
    nodes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "bits long")
    pairs = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash_dedup.links(nodes, shard).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v
    for a, b in pairs:
        parent[root(a)] = root(b)
    want = plain_components(values)
    groups, found = defaultdict(set), defaultdict(set)
    for v in values:
        groups[want[v]].add(v)
        found[root(v)].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_tree_finds_all_within_the_radius():
    values = crowded_values(9)
    tree = simhash_dedup.Tree()
    assert tree.near(5, 2) == []
    for v in values:
        tree.add(v)
    for v in values[:100]:
        for radius in (0, 2, 20):
            assert sorted(tree.values[i] for i in tree.near(v, radius)) == [x for x in values if (x ^ v).bit_count() <= radius]
    assert len(list(simhash_dedup.tree_links(values))) < len(values)


def test_near_texts_have_one_component(spark):
    rng = random.Random(6)
    pool = [f"w{i}" for i in range(500)]
    rows = [(i, " ".join(rng.choices(pool, k=400)), "en", None) for i in range(30)]
    for i in range(30, 70):  # two words added at the end move few bits
        rows.append((i, f"{rows[i % 30][1]} {rng.choice(pool)} {rng.choice(pool)}", "en", None))
    rows += [(100, None, None, None), (101, "", None, None), (102, "  \t", None, None), (103, "One", None, None),
             (104, "one", None, None), (105, "a b", None, None), (None, "A B", None, None), (None, None, None, None),
             (106, "é É " * 9000, None, None), (0, rows[1][1], None, None), (107, rows[5][1].upper(), None, None),
             (None, "only here", None, None), (108, rows[5][1], None, None), (108, rows[5][1], None, None)]
    got = simhash_dedup.near_duplicates(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    bits = [plain_fingerprint(r[1]) for r in rows]
    roots = plain_components(sorted(set(bits)))
    least = defaultdict(list)
    for row, b in zip(rows, bits):
        if row[0] is not None:
            least[roots[b]].append(row[0])
    want = Counter((row[0], f"{b:016x}", min(least[roots[b]], default=None)) for row, b in zip(rows, bits))
    assert Counter(map(tuple, got)) == want
    assert len({w[2] for w in want}) < len({w[1] for w in want})
    assert simhash_dedup.near_duplicates(documents(spark, [])).count() == 0
