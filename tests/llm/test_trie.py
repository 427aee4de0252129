"""The prefix trie against plain Python on given and on odd conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
from quarry.llm import prefix_trie
from quarry.llm.queries import ORACLES, op13_prefix_trie

CONVERSATIONS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def whole(paths):
    """Every node of the trie of {conv_id: tuple of (role, text)}."""
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = own + sum(saved[k] for k in kids[p])
    out = set()
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(paths[c]) == len(p)))
        out.add((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def in_order(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own[c].append(((turn is not None, turn or 0), key, (role, text)))
    return {c: tuple(t[-1] for t in sorted(v)) for c, v in own.items()}


def rebuilt(rows):
    own, out = in_order(rows), {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, ())[:h] + turns[h:]
    return out


def got(df):
    rows = [tuple(r) for r in df.select(*COLUMNS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_given_conversations(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(op13_prefix_trie(spark, sf)) == whole(rebuilt(rows))


def odd_rows():
    r = random.Random(3)
    rows = []
    for c in [*range(-7, 60), 10**12, 2**62]:
        for t in range(r.randint(1, 7)):
            rows.append((c, t, r.choice(["user", "assistant", None, "é"]), r.choice(["a", "b", "", None, "naïve 😀"])))
    for c in (100, 103, 104, 105, 109):  # the same long conversations, and one that ends within them
        rows += [(c, t, "u", f"t{t}") for t in range(19 if c != 104 else 11)]
    rows += [(200, None, "u", "first"), (200, None, None, None), (200, 3, "u", "x"), (200, 3, "u", "x"), (200, 3, "v", "x"), (201, -5, "u", "very long " * 20_000)]
    rows += [(None, 1, "u", "nobody's"), (None, None, None, None)]
    r.shuffle(rows)
    return rows


def test_odd_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHAIN", 3)
    monkeypatch.setattr(prefix_trie, "IDS", 2)
    monkeypatch.setattr(prefix_trie, "DEEP", 4)
    df = spark.createDataFrame(odd_rows(), CONVERSATIONS)
    assert got(prefix_trie.conversation_trie(df)) == whole(rebuilt(odd_rows()))
    assert got(prefix_trie.nodes(*prefix_trie.plain(prefix_trie.ordered(df)))) == whole(in_order(odd_rows()))


def test_one_conversation_and_none(spark):
    one = [(5, t, "u", f"{t}") for t in range(30)]
    assert got(prefix_trie.conversation_trie(spark.createDataFrame(one, CONVERSATIONS))) == whole(rebuilt(one))
    assert prefix_trie.conversation_trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0
    nobody = spark.createDataFrame([(None, 1, "u", "x")], CONVERSATIONS)
    assert prefix_trie.conversation_trie(nobody).count() == 0


def test_turnless(spark):
    """Conversation 4 takes no turns of an absent one and has fewer than it gives up."""
    c = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(c, 0, "u", "a"), (c, 1, "u", "b"), (1000, 0, "u", "c")]
    paths = rebuilt(rows)
    assert paths[c] == ()
    assert got(prefix_trie.conversation_trie(spark.createDataFrame(rows, CONVERSATIONS))) == whole(paths)


def test_clashing_columns_and_hot_conversation(spark):
    """One conversation of most rows, numbered over several ranges, and columns named as those made on the way."""
    from pyspark.sql import functions as F

    rows = [(7, t // 3, "u", str(t % 2)) for t in range(3000)] + [(c, t, "u", "1") for c in range(10, 60) for t in range(3)]
    df = spark.createDataFrame(rows, CONVERSATIONS)
    for c in ("pos", "key", "bytes", "row", "part", "len", "node", "depth", "level", "block", "base", "h"):
        df = df.withColumn(c, F.lit("clash"))
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        numbered = prefix_trie.ordered(df)
        assert sorted(r.pos for r in numbered.where("conv_id = 7").collect()) == list(range(1, 3001))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    assert got(prefix_trie.conversation_trie(df)) == whole(rebuilt(rows))


def test_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    rows = con.sql(ORACLES["op13_prefix_trie"])
    at = [rows.columns.index(c) for c in COLUMNS]
    assert {tuple(r[i] for i in at) for r in rows.fetchall()} == got(op13_prefix_trie(spark, sf))


def test_levels_stop_where_nothing_is_shared(spark):
    """Long conversations that share only their first turn make two levels, however long they are."""
    rows = [(c, t, "u", "hello" if t == 0 else f"{c}-{t}") for c in (1, 2, 3) for t in range(300)]
    df = spark.createDataFrame(rows, CONVERSATIONS)
    read = []
    real = prefix_trie._result
    try:
        prefix_trie._result = lambda groups, *a: (read.append(len(groups)), real(groups, *a))[1]
        out = prefix_trie.nodes(*prefix_trie.plain(prefix_trie.ordered(df)))
    finally:
        prefix_trie._result = real
    assert got(out) == whole(in_order(rows)) and read == [3]
