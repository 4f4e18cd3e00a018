import hashlib
import random
from collections import defaultdict

from shardloom.llm import chat_tree as C

KIND = "conv_id long, turn long, role string, text string, node string"


def conversations():
    rng = random.Random(2)
    said = ["hi", "<|im_end|>", "a\\b<|", "", None, "x\n<|im_start|>user\n", "é" * 50, "\\n|", "<"]
    roles = ["user", "assistant", "system", None, "odd\nrole", "<|x"]
    rows = []
    for c in range(60):
        turns = [("system", "one start")] if c % 3 else []
        turns += [(roles[c % 2], said[c % 4])] * (c % 5 > 1)
        turns += [(rng.choice(roles), rng.choice(said)) for _ in range(rng.randrange(4))]
        if c % 7 == 0:
            turns = [("user", "same"), ("assistant", "copy")]
        rows += [(c, t, role, text, "clash") for t, (role, text) in enumerate(turns)]
    rows += [(None, 0, "user", "no id", "x"), (None, None, "user", "no turn", "x"), (900, 1, "user", "tie", "x"), (900, 1, "user", "tie", "x"), (900, 1, "assistant", "tie", "x"), (901, 0, "user", "long " * 50_000, "x")]
    return rows


def plain(rows):
    """conv_id to its turns in order."""
    out = defaultdict(list)
    first = lambda x: (x is not None, x)
    for c, t, role, text, _ in sorted(rows, key=lambda r: (first(r[0]) if r[0] is not None else (False, 0), first(r[1]) if r[1] is not None else (False, 0), r[2] or "", r[3] or "")):
        out[c].append((role or "", text or ""))
    return out


def test_tree(spark):
    rows = conversations()
    want = plain(rows)
    nodes, members = C.chat_tree(spark, spark.createDataFrame(rows, KIND).repartition(5))
    got = sorted(nodes.collect(), key=lambda r: r.start)
    paths = defaultdict(dict)
    for m in members.collect():
        paths[m.conv_id][m.depth] = bytes(m.node)
    by = {bytes(r.node): r for r in got}
    assert len(by) == len(got) == len({tuple(t[: k + 1]) for t in want.values() for k in range(len(t))})  # shared turns once
    at = 0
    for r in got:  # emitted without gaps
        assert r.start == at and r.length == len(r.formatted)
        at += r.length
    parent = {}
    for c, turns in want.items():
        own = [by[paths[c][k]] for k in range(len(turns))]
        position = 0
        for k, r in enumerate(own):
            assert r.position == position and C.parsed(r.formatted) == [turns[k]]
            spans = {i for a in r.attends for i in range(a.lo, a.hi)} if position < 3000 else None
            assert spans is None or spans == {i for p in own[:k] for i in range(p.start, p.start + p.length)}
            assert sum(a.hi - a.lo for a in r.attends) == position
            if turns[k][0] == "assistant":
                assert C.unescaped(r.formatted[r.loss_lo : r.loss_hi]) == turns[k][1]
            else:
                assert r.loss_lo is None
            parent[bytes(r.node)] = bytes(own[k - 1].node) if k else None
            position += r.length
    seen, stack = set(), []
    for r in got:  # depth first: a node follows its parent or a finished subtree of it
        node = bytes(r.node)
        while stack and stack[-1] != parent[node]:
            stack.pop()
        assert parent[node] is None or stack
        assert node not in seen
        seen.add(node)
        stack.append(node)


def test_read_back(spark):
    rows = conversations()
    got = {r.conv_id: r for r in C.read_back(*C.chat_tree(spark, spark.createDataFrame(rows, KIND))).collect()}
    want = plain(rows)
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].formatted_chars == sum(len(C.render(r, t)[0]) for r, t in turns)


def test_empty(spark):
    nodes, members = C.chat_tree(spark, spark.createDataFrame([], KIND))
    assert nodes.count() == members.count() == 0 and C.read_back(nodes, members).count() == 0


def test_batches_of_one_kind(spark):
    """A batch without an assistant's turn, one with them only, and an empty one have one schema."""
    import pyarrow as pa

    turn = {"node": b"n", "depth": 0, "start": 0, "length": 1, "position": 0, "attends": [], "text": "t"}
    kinds = pa.schema([("node", pa.binary()), ("depth", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("position", pa.int64()), ("attends", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), ("role", pa.string()), ("text", pa.string())])
    batches = [pa.RecordBatch.from_pylist([turn | {"role": r} for r in roles], kinds) for roles in (["user"], ["assistant"], [], ["user", "assistant"])]
    assert len({b.schema for b in C._rendered(batches)}) == 1
    alone = [(c, 0, "user", f"no reply {c}", "x") for c in range(20)]
    got = C.read_back(*C.chat_tree(spark, spark.createDataFrame(alone, KIND))).collect()
    assert len(got) == 20 and all(r.loss_chars == 0 and r.loss_sha256 == hashlib.sha256(b"").hexdigest() for r in got)
