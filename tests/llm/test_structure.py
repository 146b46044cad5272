"""Conversation repair, periodic runs and order-preserving packing against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from rewardlens.llm import registry, repair, runs, windows
from tests.llm.data import WORD, prose, rows, stored, table

PATH = public_tokenizers.path("byte_bpe_50k.json")

# ---------------------------------------------------------------- conversations

CONV = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                     T.StructField("text", T.StringType()), T.StructField("part", T.StringType()), T.StructField("conv", T.LongType()), T.StructField("a.b", T.LongType())])


def conversation_rows():
    rng = random.Random(4)
    out = []
    for c in range(30):
        for t in range(rng.randint(1, 9)):
            role = "system" if t == 0 and rng.random() < 0.3 else rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ["user", "assistant"][t % 2]
            out.append((c, t + rng.randint(0, 1) * (c % 3), role, rng.choice(["Yes.", "No!", "what", " ", "", None, "a b. ", "The same.", f"Text {t}.", f"Open {c}"])))
    for t in range(160):  # a long one
        out.append((100, t, rng.choice(["user", "assistant"]), rng.choice(["Again.", f"Turn {t}?", f"turn {t}", ""])))
    out += [(200, None, "user", "First."), (200, 1, "assistant", "Second."), (200, None, "user", "First."), (201, None, None, None), (202, 5, "", "Alone."),
            (None, 1, "user", "No id."), (None, 2, "assistant", "None."), (203, 0, "tool", "x" * 70000 + "."), (204, 0, "system", "Only a system turn."),
            (205, 3, "user", "Same."), (205, 3, "user", "Same."), (205, 9, "assistant", "End.")]
    return out


def conversations(spark, tmp_path, data, name="conversations"):
    df = spark.createDataFrame([(*r, "p", 1, 2) for r in data], CONV).repartition(3)
    df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return spark.read.parquet(f"{tmp_path}/{name}.parquet")


def damaged(data):
    out = []
    for c, t, role, text in data:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        out += [(c, t, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def brute_repair(data):
    """Every conversation's report by plain recursion over (cost, edits) pairs."""
    out = {}
    for c in {r[0] for r in data}:
        own = sorted((r for r in data if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faults = set(), []
        for _, _, role, text in own:
            last = re.sub(r"[\x20\x09-\x0D]", "", text)[-1:]
            faults.append("b" if not last else "d" if (role, text) in seen else None if last in ".!?" else "t")
            seen |= {(role, text)} if last else set()
        initials = [r[2][:1] for r in own]
        after = {0: (0, ""), 1: (4, "II"), 2: (2, "I"), 3: (0, "")}
        for x, f in zip(initials[::-1], faults[::-1]):
            here = {}
            for q in range(4):
                turn = 3 if q == 2 else 2
                ways = [(after[q][0] + 3, "D" + after[q][1])]
                if f not in ("b", "d"):
                    keep = 1 if (x, q) == ("s", 0) else turn if x == ("a" if q == 2 else "u") else None
                    if keep:
                        ways.append((after[keep][0] + (f == "t"), "K" + after[keep][1]))
                    ways.append((after[turn][0] + 2 + (f == "t"), "R" + after[turn][1]))
                here[q] = min(ways)
            for _ in range(4):
                here = {q: min(here[q], (here[3 if q == 2 else 2][0] + 2, "I" + here[3 if q == 2 else 2][1])) for q in here}
            after = here
        cost, audit = after[0]
        lines, state, i = [], "", 0
        for e in audit:
            if e in "IR":
                state = "assistant" if state == "user" else "user"
                lines.append(f"{state}:{'' if e == 'I' else own[i][3]}")
            elif e == "K":
                state = {"u": "user", "a": "assistant"}.get(own[i][2][0], "")
                lines.append(f"{own[i][2]}:{own[i][3]}")
            i += e != "I"
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[c] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repair_query(spark, tmp_path):
    got = registry.op11_conversation_repair(spark, str(tmp_path)).collect()
    assert len(got) == len({r["conv_id"] for r in got})
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in got}


@pytest.mark.parametrize("chunk", [4096, 5])
def test_repair_against_brute_force(spark, tmp_path, monkeypatch, chunk):
    """All at once, and in segments of five rows so that most conversations are divided."""
    whole = repair.repair
    monkeypatch.setattr(repair, "repair", lambda rows: whole(rows, chunk=chunk))
    data = conversation_rows()
    conversations(spark, tmp_path, data)
    want = brute_repair(damaged(data))
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair_query(spark, tmp_path) == {c: want.get(c, none) for c in {r[0] for r in data}}


def test_repair_of_an_empty_table(spark, tmp_path):
    conversations(spark, tmp_path, [])
    assert repair_query(spark, tmp_path) == {}


def test_auction_prices_and_audits():
    rng = random.Random(1)
    for _ in range(3000):
        n = rng.randint(0, 7)
        data = [(0, t, rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(["", "Twice.", f"Ends {t}.", f"Open {t}"])) for t in range(n)]
        faults = repair.faults_of([r[2] for r in data], [r[3] for r in data])
        steps = repair.steps_of([r[2][:1] for r in data], faults)
        price = repair.auction(steps, repair.END_COST)
        audit, state = repair.trace(steps, price, 0)
        audit += repair.END_EDITS[state]
        if data:
            assert (price[0][0], audit) == brute_repair(data)[0][5:7]
        turns = repair.apply_edits(audit, [r[2] for r in data], [r[3] for r in data], 0)
        assert re.fullmatch("(s?(ua)+)?", "".join(t["role"][0] for t in turns))


def test_repaired_turns_are_texts_of_the_input(spark, tmp_path):
    data = [(1, 0, "user", "Hello."), (1, 1, "user", "How are you?"), (1, 2, "assistant", "Well.")]
    found = repair.repair(conversations(spark, tmp_path, data))
    turns = [tuple(x) for r in found.turns.collect() for x in r["lines"]]
    assert turns == [("I", "user", ""), ("R", "assistant", "Hello."), ("K", "user", "How are you?"), ("K", "assistant", "Well.")] or \
        [t[0] for t in turns] == list(brute_repair(data)[1][6].replace("D", ""))


# ---------------------------------------------------------------- periodic runs


def brute_runs(words, least=12):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        for same, group in itertools.groupby(words[j] == words[j + q] for j in range(n - q)):
            k = len(list(group))
            if same and k + q >= max(least, 2 * q):
                found.setdefault((i, k + q), q)
            i += k
    return sorted((s, q, n) for (s, n), q in found.items())


def awkward_words(rng):
    a = rng.choice([1, 1, 2, 3, 30])
    out = []
    for _ in range(rng.randint(1, 9)):
        r = rng.random()
        unit = [rng.randint(0, a) for _ in range(rng.randint(1, 60))]
        if r < 0.3:  # periods inside periods
            unit = ([rng.randint(0, 1) for _ in range(rng.randint(1, 6))] * 60)[:rng.randint(1, 80)]
        if r < 0.7:
            out += (unit * 5)[:int(len(unit) * rng.uniform(1.5, 4.5))]
        elif out and r < 0.85:
            k = rng.randrange(len(out))
            out += out[k:k + rng.randint(1, 120)]
        else:
            out += unit
    return out


def test_runs_against_brute_force():
    rng = random.Random(11)
    seen = 0
    for _ in range(80):
        docs = [awkward_words(rng) for _ in range(rng.randint(1, 5))] + [[]]
        bounds = np.r_[0, np.cumsum([len(d) for d in docs])]
        start, length, period = runs.runs_of(np.array(sum(docs, []), np.int32), bounds)
        owner = np.searchsorted(bounds, start, "right") - 1
        got = [(int(o), int(s - bounds[o]), int(q), int(n)) for o, s, q, n in zip(owner, start, period, length)]
        want = [(o, *x) for o, d in enumerate(docs) for x in brute_runs(d)]
        assert got == want
        seen += sum(x[2] >= runs.SHORT for x in want)
    assert seen > 500


def test_runs_at_every_scale():
    """One run of each period, in random words, and a periodic text that holds only touching runs."""
    rng = random.Random(5)
    for q in [*range(1, 70), 100, 191, 192, 193, 500, 1536]:
        unit = [rng.randint(0, 10**6) for _ in range(q)]
        n = max(12, 2 * q + rng.randint(0, q))
        words = [-1, -2, *(unit * 13)[:n], -3]
        start, length, period = runs.runs_of(np.array(words), np.array([0, len(words)]))
        assert (2, n, q) in set(zip(start.tolist(), length.tolist(), period.tolist()))
    words = [0, 1] * 60 + [1, 0] * 60
    start, length, period = runs.runs_of(np.array(words), np.array([0, len(words)]))
    assert sorted(zip(start, period, length)) == brute_runs(words)


def test_runs_of_long_texts():
    for words in ([7] * 300_000, [0, 1, 2] * 100_000, list(range(200_000)), list(range(100_000)) * 2):
        start, length, period = runs.runs_of(np.array(words), np.array([0, len(words)]))
        assert list(zip(start, length, period)) == ([(0, len(words), len(set(words)))] if 2 * len(set(words)) <= len(words) else [])


def test_runs_query_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    data = rows() + [(900 + i, " \n".join(f"w{x}" for x in awkward_words(rng)), "en") for i in range(40)]
    data = [r for r in data if r[1] is None or len(r[1]) < 6000]
    stored(spark, tmp_path, data)
    want = []
    for i, text, _ in data:
        w = WORD.findall(text or "")
        h = None if i is None else zlib.crc32(str(i).encode())
        if h is not None and h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[k if k < a else a + (k - a) % p] for k in range(len(w))]
        found = brute_runs(w)
        best = max(found, key=lambda r: (r[2], -r[0], -r[1]), default=None)
        gone = {k for s, q, n in found for k in range(s + q, s + n)}
        listed = "".join(f"{s},{n},{q}\n" for s, q, n in found)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(found), *((best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4),
                     hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r[:8]) for r in registry.op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_runs_of_an_empty_table(spark, tmp_path):
    stored(spark, tmp_path, [])
    assert registry.op12_periodic_runs(spark, str(tmp_path)).collect() == []


# ---------------------------------------------------------------- windows


def padding(n, capacity):
    return 0 if n & (n - 1) == 0 else capacity - n


def test_cuts_against_all_cuts():
    rng = random.Random(3)
    for _ in range(400):
        capacity, at, cost = rng.choice([8, 16, 64]), [0], [0]
        for _ in range(rng.randint(1, 40)):
            at.append(at[-1] + rng.randint(1, capacity))
            cost.append(rng.choice([0, 4, 32]))
        least = [0]
        for j in range(1, len(at)):
            least.append(windows.WINDOW + cost[j] + min(least[i] + padding(at[j] - at[i], capacity) for i in range(j) if at[j] - at[i] <= capacity))
        cuts = windows.best_cuts(np.array(at), np.array(cost), capacity)
        assert cuts[0] == 0 and cuts[-1] == len(at) - 1
        sizes = [at[b] - at[a] for a, b in zip(cuts, cuts[1:])]
        assert max(sizes) <= capacity
        assert sum(windows.WINDOW + cost[b] + padding(s, capacity) for b, s in zip(cuts[1:], sizes)) == least[-1]


def test_sentences_are_cut_points():
    encoder = windows.ChunkEncoder.of(PATH)
    tables = windows.sentence_tables(encoder)
    text = 'One two three. Four "five"? Six 3.14 seven!\nEight e.g.x nine'
    ids = np.array(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids + [1], np.uint32)
    at, cost = windows.cut_points(ids, np.array([len(ids)]), *tables, 2048)
    heads = [Tokenizer.from_file(PATH).decode(ids[:a].tolist()) for a in at[:-1]]
    assert "One two three." in heads and 'One two three. Four "five"?' in heads and any(h.endswith(("seven!", "seven!\n")) for h in heads)
    assert not any(h.endswith(("3.", " e.", "e.g.")) for h in heads) and cost[0] == 0 and cost[-1] == 0


@pytest.mark.parametrize("block", [1, 3000, 1 << 20])
def test_windows_hold_every_id_once(spark, tmp_path, block):
    data = rows()
    got = windows.pack_in_order(stored(spark, tmp_path, data), PATH, block=block).collect()
    tok = Tokenizer.from_file(PATH)
    ids = {}
    for i, text, _ in data:
        ids.setdefault(i, []).append(np.array(tok.encode(text or "", add_special_tokens=False).ids + [1], "<u4"))
    pieces, seqs = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        assert sum(r["length"] for r in own) == sum(map(len, ids[i]))
        for r in own:
            assert any(len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in ids[i])
        if len(ids[i]) == 1:
            end = 0
            for r in sorted(own, key=lambda r: r["start"]):
                assert r["start"] == end
                end += r["length"]
    sizes = []
    for own in seqs.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end and length > 0
            end += length
        sizes.append(end)
    assert max(sizes) <= windows.CAPACITY
    if block > 3000:
        assert sum(padding(s, windows.CAPACITY) for s in sizes) < 0.02 * sum(sizes)


def test_windows_of_an_empty_table_and_bad_capacity(spark, tmp_path):
    docs = stored(spark, tmp_path, [])
    assert windows.pack_in_order(docs, PATH).collect() == []
    with pytest.raises(ValueError):
        windows.pack_in_order(docs, PATH, capacity=1000)
