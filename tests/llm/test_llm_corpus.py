"""Line dedup, source divergence and the prefix trie against plain versions, with bounds so small that every way is taken."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from mensura.llm import divergence, linededup, trie

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, kept int"


def _documents(spark):
    rng = np.random.default_rng(4)
    lines = ["Menu", " menu\t", "MENÜ", "about US", "", "  ", "x", "ßtraße", "Größe 12", "a\x0bb", "unique", "one,two one", "foo, (Foo) foo-bar", "don't"]
    rows = [(i, "\n".join(rng.choice(lines, rng.integers(1, 9))) + ("\n" if i % 5 == 0 else ""), [None, "en", "de", ""][i % 4], [None, "s1", "s2", "hot"][min(3, i % 7)]) for i in range(60)]
    rows += [(100 + i, "copy line\nof many\nMenu", "en", "hot") for i in range(40)]
    rows += [(7, "repeated id\nMenu", "en", "s1"), (7, "repeated id\nMenu", "en", "s1"), (None, "no id\nmenu", "en", "s1"), (200, None, None, None), (201, "", "xx", "lonely"), (202, "\n\n", "xx", "other"), (203, "word " * 40_000 + "\nmenu", "de", "hot")]
    return rows, spark.createDataFrame([(*r, None, "clash", 0) for r in rows], DOCS).repartition(7)


def _key(line):
    return re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip("\x20\x09\x0a\x0b\x0c\x0d"))


def _deduped(rows, least, chars=1, first=False):
    docs, ids = Counter(), {}
    for i, t, *_ in rows:
        for k in {_key(x) for x in (t or "").split("\n")}:
            docs[k] += 1
            if i is not None:
                ids[k] = min(ids.get(k, i), i)
    out = []
    for i, t, *_ in rows:
        kept, seen, lines = [], set(), (t or "").split("\n")
        for x in lines:
            k = _key(x)
            gone = len(k) >= chars and docs[k] >= least
            if not gone or (first and k not in seen and ids.get(k) == i):
                kept.append(x)
            if gone:
                seen.add(k)
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "keep_first": True, "min_chars": 5}, {"keep_first": True, "most_bits": 64}], ids=["sent", "joined", "first", "full filter"])
def test_line_dedup(spark, monkeypatch, options):
    monkeypatch.setattr(linededup, "ENTRIES", 6)
    if "most_bits" in options:
        monkeypatch.setattr(linededup, "LEAST_BITS", 64)
    rows, docs = _documents(spark)
    got = linededup.line_dedup(docs, min_docs=9, **options)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _deduped(rows, 9, options.get("min_chars", 1), options.get("keep_first", False))
    assert linededup.line_dedup(docs.where("false"), **options).count() == 0


def test_filters_lose_no_repeat(spark):
    """Keys of two documents are in the merged filter, wherever the documents lie; few others are."""
    keys = [f"line {i}" for i in range(4000)]
    docs = spark.createDataFrame([(i, "\n".join([keys[i], keys[(i * 7 + 1) % 2000]])) for i in range(2000)] + [(9000 + i, keys[2000 + i]) for i in range(2000)], "doc_id long, text string").repartition(16)
    bits = 1 << 17
    twice = np.frombuffer(linededup.twice_filter(docs, bits), np.uint8)
    held = linededup._are_set(twice, linededup.bit_places([k.encode() for k in keys], bits))
    assert held[:2000].all() and held[2000:].mean() < 0.05


def _divergence(rows, least, top):
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    count, docs, groups = Counter(), Counter(), set()
    for _, t, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", fold(t))
        groups.add((lang, source))
        docs.update((lang, x) for x in set(terms))
        count.update((lang, source, x) for x in terms)
    out = []
    for lang in {g[0] for g in groups}:
        own = sorted(s for g, s in groups if g == lang)
        kept = [x for (g, x), n in docs.items() if g == lang and n >= least]
        share = lambda c, kept=kept: {x: 1 + 1_000_000_000 * (c.get(x, 0) + 1) // (sum(c.get(y, 0) for y in kept) + len(kept)) for x in kept}
        of = {s: {x: count[lang, s, x] for x in kept} for s in own}
        p = {s: share(of[s]) for s in own}
        q = share({x: sum(of[s][x] for s in own) for x in kept})
        f = lambda a, b: (a - b) ** 2 // b
        for s in own:
            pairs = sorted(((-sum(f(p[s][x], p[o][x]) for x in kept), o.encode()) for o in own if o != s))
            terms = sorted((-f(p[s][x], q[x]), x.encode()) for x in kept if of[s][x] and p[s][x] > q[x])[:top]
            out += [(lang, s, part, i.decode(), -v, r) for part, ranked in (("pair", pairs), ("term", terms)) for r, (v, i) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("entries,block,small,least,top", [(1_000_000, 8 << 20, 100_000, 3, 200), (5, 1, 0, 4, 2)], ids=["plain", "tight"])
def test_divergence(spark, monkeypatch, entries, block, small, least, top):
    for k, v in {"ENTRIES": entries, "BLOCK_BYTES": block, "SMALL": small}.items():
        monkeypatch.setattr(divergence, k, v)
    rows, docs = _documents(spark)
    got = divergence.divergence(docs, least, top)
    assert sorted(tuple(r) for r in got.collect()) == _divergence(rows, least, top)
    assert divergence.divergence(docs.where("false")).count() == 0


def test_a_document_counts_once_for_two_chunks(spark):
    """foo, and foo. of one document are one document of foo."""
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(["foo, foo. (foo)", "foo", "bar, bar.", "bar", "bar-bar"])], "doc_id long, text string, lang string, source string")
    assert [r.term for r in divergence.term_counts(docs, 3)[1].collect()] == ["bar"]


def _trie(rows, rebuild=True):
    turns = {}
    for c, n, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((n, role or "", text or ""))
    digest = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()
    own = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, digest(x[1], x[2])))] for c, v in turns.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + own[c][h:]
    members, ends = {}, {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
        ends.setdefault(tuple(seq), []).append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in members.items())


@pytest.mark.parametrize("stretch,memory,piece", [(1024, 200_000, 4096), (3, 2, 2)], ids=["plain", "tight"])
def test_prefix_trie(spark, monkeypatch, stretch, memory, piece):
    monkeypatch.setattr(trie, "STRETCH", stretch)
    monkeypatch.setattr(trie, "PIECE", piece)
    rng = np.random.default_rng(8)
    rows = []
    for c in range(-5, 130):
        if c in (40, 61):
            continue
        if c % 3 == 0:  # copies
            rows += [(c, 0, "user", "hello you"), (c, 1, "assistant", "yes  of course "), (c, 2, "user", None)]
        else:
            rows += [(c, int(t) if rng.random() < 0.9 else None, ["user", None, "assistant"][int(rng.integers(3))], ["hello you", "", None, "a b c", "tie", "ü x\x0by"][int(rng.integers(6))]) for t in range(int(rng.integers(1, 7)))]
    rows += [(300, i, "user", f"turn {i % 2}") for i in range(40)] + [(301, i, "user", f"turn {i % 2}") for i in range(33)] + [(301, 33, "user", "another")]
    rows += [(5, 1, "user", "twice")] * 2 + [(None, 1, "user", "lost")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, depth string").repartition(6)
    got = trie.prefix_trie(*trie.rebuilt(trie.ordered_turns(df)), most=memory)
    assert sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, *r[3:]) for r in got.collect()) == _trie(rows)
    assert trie.prefix_trie(*trie.rebuilt(trie.ordered_turns(df.where("false")))).count() == 0


def test_spilling_queue():
    rng, queue, plain = np.random.default_rng(0), trie.SpillingQueue(5), []
    for step in range(4000):
        if step % 3 < 2:
            item = (int(rng.integers(1000)), step)
            queue.push(item)
            plain.append(item)
        else:
            plain.sort()
            assert queue.peek() == plain[0] and queue.pop() == plain.pop(0)
    assert [queue.pop() for _ in range(len(plain))] == sorted(plain) and queue.peek() is None
