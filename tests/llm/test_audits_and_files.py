"""Conversation repair, filter interactions and token files against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fieldcast.llm import conversation_repair, filter_audit, token_files
from tests.llm import corpus

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def _brute(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """Cheapest edits of (role initial, must go, truncated) by trying all of them, with up to two insertions in a row."""
    best = None
    fills = ["", "u", "a", "ua", "au"]
    options = []
    for initial, gone, late in rows:
        stays = [] if gone else [(5 * late, "K", initial), (1 + 5 * late, "R", "u"), (1 + 5 * late, "R", "a")]
        options.append([(2, "D", ""), *stays])
    for edits in itertools.product(*options):
        for inserted in itertools.product(fills, repeat=len(rows) + 1):
            said = inserted[0] + "".join(e[2] + f for e, f in zip(edits, inserted[1:]))
            if GRAMMAR.match(said):
                audit = "I" * len(inserted[0]) + "".join(e[1] + "I" * len(f) for e, f in zip(edits, inserted[1:]))
                found = (sum(e[0] for e in edits) + 5 * sum(map(len, inserted)), audit)
                best = found if best is None else min(best, found)
    return best


@pytest.mark.parametrize("stretch", [1, 2, 12])
def test_auction_finds_the_first_of_the_cheapest_repairs(stretch):
    rng = random.Random(stretch)
    for _ in range(60):
        rows = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 3))]
        kinds = [("d" if gone else initial.upper() if late else initial, 1) for initial, gone, late in rows]
        prices, routes = conversation_repair.sweep(kinds, stretch=stretch)
        audit, _ = conversation_repair.lines(conversation_repair.follow(routes, 0)[0], [i for i, _, _ in rows], [""] * len(rows), 0, True)
        assert (prices[0], audit) == _brute(rows)


def _by_hand(rows: list[tuple]) -> dict:
    """Every column of one conversation's rows (turn, role, text), with a plain search back from the end."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    counts, kinds, seen = Counter(), [], set()
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        kinds.append(fault)
    best = {0: (0, "", []), 1: (10, "II", ["user:", "assistant:"]), 2: (5, "I", ["assistant:"]), 3: (0, "", [])}
    says, gives = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}], [("user", 2), ("user", 2), ("assistant", 3), ("user", 2)]
    for (_, role, text), fault in reversed(list(zip(rows, kinds))):
        late, now = 5 * (fault == "truncated"), {}
        for q in range(4):
            ways = [(best[q][0] + 2, "D" + best[q][1], best[q][2])]
            if fault in ("", "truncated"):
                if role[:1] in says[q]:
                    c, a, out = best[says[q][role[:1]]]
                    ways.append((c + late, "K" + a, [f"{role}:{text}", *out]))
                given, t = gives[q]
                ways.append((best[t][0] + 1 + late, "R" + best[t][1], [f"{given}:{text}", *best[t][2]]))
            now[q] = min(ways)
        for _ in range(3):
            for q in range(4):
                given, t = gives[q]
                now[q] = min(now[q], (now[t][0] + 5, "I" + now[t][1], [f"{given}:", *now[t][2]]))
        best = now
    turns = {r[0] for r in rows} - {None}
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in {"su", "ua", "au"} for a, b in zip(initials, initials[1:]))
    return {"gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, "blank": counts["blank"], "duplicate": counts["duplicate"], "truncated": counts["truncated"],
            "illegal": illegal, "cost": best[0][0], "audit": best[0][1], "repaired_sha256": hashlib.sha256("\n".join(best[0][2]).encode()).hexdigest()}


def _conversations(rng: random.Random) -> list[tuple]:
    said = [".", "One.", "Two", "Three!", "", " \n", "four?  ", "a.b.c", "x" * 3000 + ".", None]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(said)) for c in range(40) for t in range(rng.randint(0, 9))]
    long_ = [(77, rng.choice([t, t // 2, None]), rng.choice(["user", "assistant", "assistant", "user", "system"]), f"{rng.choice(said)} {rng.randint(0, 500)}{rng.choice(['.', ''])}") for t in range(700)]
    return rows + long_ + [(None, 1, "user", "Hm."), (None, 2, "assistant", "So?"), (None, None, None, None), (5, 2, "user", "Two")] + [(78, 1, "user", "Same.")] * 30


@pytest.mark.parametrize("block_rows", [3, 4096])
def test_repaired_conversations(spark, block_rows):
    rows = _conversations(random.Random(4))
    df = spark.createDataFrame([(c, t, r, x, "n", "p") for c, t, r, x in rows], "conv_id long, turn long, role string, text string, n string, part string").repartition(5)
    got = conversation_repair.digests(conversation_repair.repair(conversation_repair.damage(df), block_rows=block_rows)).collect()
    groups = defaultdict(list)
    for c, t, r, x in rows:
        r, x, name = r if r is not None else " ", x if x is not None else " ", f"{' ' if c is None else c}:{' ' if t is None else t}"
        deal = zlib.crc32(name.encode()) % 20
        x = "" if deal == 1 else re.sub("[.!?]", "", x) if deal == 2 else x
        groups[c] += [(t, "user" if deal == 4 else r, x)] * (0 if deal == 0 else 2 if deal == 3 else 1)
    assert len(got) == len(groups)
    for row in got:
        assert row.asDict() == {"conv_id": row.conv_id} | _by_hand(groups[row.conv_id])


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert conversation_repair.digests(conversation_repair.repair(conversation_repair.damage(df))).count() == 0


def test_path_counts_are_orders():
    forward, backward = filter_audit.path_counts(4)
    for state in range(16):
        inside, outside = [f for f in range(4) if state >> f & 1], [f for f in range(4) if not state >> f & 1]
        assert (forward[state], backward[state]) == (len(list(itertools.permutations(inside))), len(list(itertools.permutations(outside))))


def test_every_order_of_filters_by_hand(spark):
    rng = random.Random(3)
    texts = ["", None, "A b", "word " * 300, " ".join(f"w{i}" for i in range(250)), "AB CD " * 150, "so # it is", " ".join(f"w{i}" for i in range(210)) + " $", "word " * 300]
    rows = [(i, rng.choice(texts), rng.choice(["web", "", None, "book"])) for i in range(60)] + [(7, "A b", "web"), (7, "A b", "web"), (None, "A b", "book")]
    marks = {i: (rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 60, 2)}
    docs = spark.createDataFrame([(i, t, s, 1, "x") for i, t, s in rows], "doc_id long, text string, source string, n int, part string").repartition(3)
    labels = spark.createDataFrame([(i, q, t) for i, (q, t) in marks.items()], "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(docs, labels).collect()}

    def fails(i, text):
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        found = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)),
                 "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)}
        return {k for k, v in found.items() if v}

    judged = [(s or "", fails(i, t), *marks.get(i, (0, 0))) for i, t, s in rows]
    want = {}
    for part in {p for p, *_ in judged}:
        for order in itertools.permutations("ABCDE"):
            left = [j for j in judged if j[0] == part]
            for k, f in enumerate(order):
                gone = [j for j in left if f in j[1]]
                left = [j for j in left if f not in j[1]]
                everyone = [j for j in judged if j[0] == part and f in j[1]]
                want[part, "".join(order), k + 1] = [len(left), len(gone), len(everyone) - len(gone), sum(j[1] == {f} for j in everyone), sum(j[2] for j in gone), sum(j[3] for j in gone)]
        for f in "ABCDE":
            total = sum(v[1] for (p, o, k), v in want.items() if p == part and o[k - 1] == f)
            for (p, o, k), v in want.items():
                if p == part and o[k - 1] == f:
                    v.append(total)
    assert got == {k: tuple(v) for k, v in want.items()}
    assert filter_audit.audit(docs.limit(0), labels).count() == 0


def test_control_bytes_round_trip():
    rng = np.random.default_rng(1)
    for sizes in ([], [0], [1, 0, 3], [4, 5, 1000, 2]):
        sizes = np.array(sizes, np.int64)
        n = int(sizes.sum())
        ranks = (rng.integers(0, 1 << 32, n, np.uint64) >> rng.integers(0, 32, n, np.uint64)).astype(np.uint32)
        control, at, data, begin = token_files.pack(ranks, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
        assert (token_files.unpack(control, data, sizes) == ranks).all()
        assert len(control) == at[-1] == (-(-sizes // 4)).sum() and len(data) == begin[-1]


@pytest.mark.parametrize("shard_bytes", [200, 4 << 20])
def test_files_hold_every_id(spark, shard_bytes):
    odd = ["It's  <|endoftext|> we'll go", "é É\tÅΣΣ", "<|startoftext|>", "１２３ ٣", "x" * 5000 + "漢" * 300, "a b\x85c\x0bd\x1ce"]
    rows = corpus.texts() + [(1000 + i, t) for i, t in enumerate(odd)]
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    folder = token_files.write(corpus.frame(spark, rows), shard_bytes=shard_bytes)
    got = token_files.read(spark, folder, with_ids=True).collect()
    want = Counter()
    for i, t in rows:
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[i, len(ids), zlib.crc32(ids), ids.tobytes()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in got) == want
    place = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == place
        place += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_no_documents_no_files(spark):
    folder = token_files.write(corpus.frame(spark, [(1, "a")]).limit(0))
    assert token_files.read(spark, folder).count() == 0
