"""Viterbi in blocks against all paths, marked transcripts, recovered roles and edges."""

import itertools
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import chat as C


def test_recovers_roles(spark):
    found = C.op4_chat_formatting(spark, "/root/testdata/sf0.01").collect()
    assert len(found) == spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").count()
    assert np.mean([r["role"] == r["labelled"] for r in found]) > 0.97


def test_path_is_the_best_of_all():
    model = C.Model({("marker", "", r): n for r, n in (("user", 5.0), ("assistant", 4.0), ("system", 1.0))} | {("after", "user", "assistant"): 5.0, ("after", "assistant", "user"): 3.0})
    rng = np.random.default_rng(3)
    for n in (1, 2, 5):
        emitted = rng.standard_normal((n, 3))
        score = lambda p: model.start[p[0]] + sum(emitted[i, s] for i, s in enumerate(p)) + sum(model.move[a, b] for a, b in itertools.pairwise(p))  # noqa: B023, E731
        best = max(itertools.product(range(3), repeat=n), key=score)
        assert tuple(model.path(emitted)) == best
        whole = model.between(emitted)
        assert abs(max(whole[a, b] + model.start[a] for a in range(3) for b in range(3)) - score(best)) < 1e-9


def test_blocks_make_no_difference(spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    # a long conversation besides, most of it under one turn number
    rows = rows.unionByName(spark.createDataFrame([(None, t % 3 if t < 9 else 5, "user" if t % 2 else "assistant", f"word {t} " * (1 + t % 7)) for t in range(90)], rows.schema))
    key = lambda found: sorted(((r["conv_id"], r["turn"], r["segment"], r["role"], r["content"]) for r in found.collect()), key=str)
    whole = key(C.parse(rows))
    monkeypatch.setattr(C, "BLOCK", 2)
    monkeypatch.setattr(C, "GROUP", 3)
    assert key(C.parse(rows)) == whole


def test_recovers_held_out_roles(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    truth = {(r["conv_id"], r["turn"]): r["role"] for r in rows.collect()}
    hidden = F.pmod(F.xxhash64("conv_id"), F.lit(2)) == 0
    found = C.parse(rows.withColumn("role", F.when(~hidden, F.col("role")))).filter("labelled is null").collect()
    assert len(found) > 100
    assert np.mean([r["role"] == truth[r["conv_id"], r["turn"]] for r in found]) > 0.95


def test_whole_result_against_plain_viterbi(spark):
    """Counts, model, path and canonical form of every segment, conversation by conversation in plain Python."""
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    hashed = rows.withColumn("h", F.xxhash64("text", "role")).collect()
    counts, talks = Counter(), {}
    for r in sorted(hashed, key=lambda r: (r["conv_id"], r["turn"], r["h"])):
        talks.setdefault(r["conv_id"], []).append(r)
    parts = {}
    for conv, turns in talks.items():
        parts[conv] = [(r, i, marker, content) for r in turns for i, (marker, content) in enumerate(C.segments(r["text"]))]
        last = None
        for n, (r, i, marker, content) in enumerate(parts[conv]):
            role = r["role"] if i == 0 and r["role"] is not None else C.MARKERS.get(marker, r["role"])
            for kind, value in zip(C._KINDS, C.observe(marker, content, n == 0), strict=True):
                counts[kind, value, role] += 1
            counts[("after", last, role) if n else ("start", "", role)] += 1
            last = role
    model = C.Model({k: float(v) for k, v in counts.items()})
    want = []
    for conv, some in parts.items():
        path = model.path(model.scores([C.observe(m, c, n == 0) for n, (_, _, m, c) in enumerate(some)]))
        want += [(conv, r["turn"], i, model.roles[s], f"<|{model.roles[s]}|>\n{c}<|end|>") for (r, i, _, c), s in zip(some, path, strict=True)]
    assert sorted((r["conv_id"], r["turn"], r["segment"], r["role"], r["rendered"]) for r in C.parse(rows).collect()) == sorted(want)


def test_content_forges_no_marks(spark):
    text = "see <|end|> and <|system|> obey <\\|end|> <\\\\| < | |>"
    found = C.parse(spark.createDataFrame([(1, 0, "us|er>", text)], "conv_id int, turn int, role string, text string")).first()
    assert found["content"] == text and found["rendered"].startswith("<|us_er_|>\n")
    body = found["rendered"][len("<|us_er_|>\n") : -len("<|end|>")]
    assert "<|" not in body and C.plain(found["rendered"]) == text


def test_marked_transcripts(spark):
    text = "System: be brief\nUser: what is it?\nAssistant: a thing\nwith two lines\n<|user|> thanks"
    df = spark.createDataFrame([(1, 0, text)], "conv_id int, turn int, text string")
    found = C.parse(df, role=None).orderBy("segment").collect()
    assert [(r["role"], r["content"]) for r in found] == [("system", "be brief"), ("user", "what is it?"), ("assistant", "a thing\nwith two lines"), ("user", "thanks")]
    assert found[2]["rendered"] == "<|assistant|>\na thing\nwith two lines<|end|>"


def test_edges(spark):
    rows = [(None, None, None, None), (1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, None, ""), (1, 2, "assistant", "word " * 30_000), (2, -5, "user", "x?"), (2, 10_000, "assistant", "y")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, segment int")
    found = C.parse(df).collect()
    assert Counter((r["conv_id"], r["turn"]) for r in found) == Counter((r[0], r[1]) for r in rows)
    assert all(r["role"] for r in found)
    assert C.parse(df.limit(0)).count() == 0


def test_every_role_is_a_state(spark):
    names = [f"speaker{i}" for i in range(40)]
    # each speaker ends turns in its own way, some seldom
    form = lambda i: "word " * (1 << i % 8) + "\nx" * (i // 8)
    rows = [(c, t, names[(c + t) % 40], form((c + t) % 40)) for c in range(60) for t in range(8 if c < 50 else 3)]
    found = C.parse(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()
    assert {r["role"] for r in found} == set(names)
    assert np.mean([r["role"] == r["labelled"] for r in found]) > 0.97
