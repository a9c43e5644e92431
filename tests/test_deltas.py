"""Levelled deltas: bounded reads, crashes between the steps, repeats, cleaning."""

import os
import random

import pytest

from worldstate.session import fresh_dir
from worldstate.streaming.deltas import DeltaLog
from worldstate.streaming.state_table import LastMessages, PartialStateTable, StateTable

SCHEMA = "k int, seq int, op string, x double"


def _batch(spark, rng, n, at):
    rows = [(rng.randrange(6), at * 100 + i, rng.choice(["add", "update", "delete"]), rng.choice([None, float(i)])) for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA).coalesce(1)


def _last(rows):
    state = {}
    for k, seq, op, x in sorted(rows, key=lambda r: r[1]):
        state[k] = (op, x)
    return {k: x for k, (op, x) in state.items() if op != "delete"}


def test_reads_stay_bounded_and_old_files_go(spark):
    table, rng, seen = StateTable(fresh_dir(spark, "t"), ["k"], ["seq"], SCHEMA, fan=2, keep=3), random.Random(1), []
    for i in range(20):
        rows, df = _batch(spark, rng, 3, i)
        seen += rows
        before = table.current(spark)
        table.write(df, i)
        before.count()  # a reader under way still finds its files
    m = table.log.manifest(spark)
    assert (m.batch, m.version) == (19, 20) and sorted(level for level, _ in m.deltas) == [2, 4]  # 20 = 4 + 16
    assert {r.k: r.x for r in table.current(spark).collect()} == _last(seen)
    folder = table.path.removeprefix("file:")
    assert set(os.listdir(f"{folder}/deltas")) == {n for _, n in (*m.deltas, *m.retired)}
    assert all(at > m.version - 3 for at, _ in m.retired) and len([n for n in os.listdir(f"{folder}/manifests") if n.isdigit()]) <= 3


@pytest.mark.parametrize("step", ["_write", "_commit", "_clean"])
def test_crash_between_the_steps_loses_and_doubles_nothing(spark, monkeypatch, step):
    table, rng, seen = StateTable(fresh_dir(spark, "t"), ["k"], ["seq"], SCHEMA, fan=2, keep=1), random.Random(2), []
    for i in range(6):
        rows, df = _batch(spark, rng, 3, i)
        calls, whole = [], getattr(DeltaLog, step)

        def dies(self, *args):
            calls.append(step)
            if step != "_write" or len(calls) == 2:  # in the middle of a merge
                raise OSError("lost")
            return whole(self, *args)

        state = {r.k: r.x for r in table.current(spark).collect()}
        with monkeypatch.context() as patch:
            patch.setattr(DeltaLog, step, dies)
            failed = False
            try:
                table.write(df, i)
            except OSError:
                failed = True
        if failed and step != "_clean":
            assert {r.k: r.x for r in table.current(spark).collect()} == state == _last(seen)
        table.write(df, i)
        seen += rows
        assert {r.k: r.x for r in table.current(spark).collect()} == _last(seen)
    assert len(table.log.manifest(spark).deltas) == 2


def test_seeds_repeats_and_lost_checkpoints(spark):
    table = StateTable(fresh_dir(spark, "t"), ["k"], ["seq"], SCHEMA)
    one = spark.createDataFrame([(1, 1, "add", 1.0)], SCHEMA)
    assert table.current(spark).count() == 0
    table.write(one, 0)
    table.write(one, 4)
    for _ in range(2):
        table.write(spark.createDataFrame([(2, 0, "add", 2.0)], SCHEMA), -1)
    assert len(table.log.manifest(spark).deltas) == 3 and table.current(spark).count() == 2
    with pytest.raises(ValueError, match="another checkpoint"):
        table.write(one, 2)


def test_partial_updates_and_chat_equal_one_pass(spark):
    schema, rng, rows = "k int, seq int, op string, name string, ip string", random.Random(3), []
    partial = PartialStateTable(fresh_dir(spark, "t"), ["k"], ["seq"], schema, ["name", "ip"], fan=3)
    chat = LastMessages(fresh_dir(spark, "t"), "channel int, seq int", ["channel"], ["seq"], n=4, fan=3)
    lines, places = [], rng.sample(range(1000), 60)  # changes arrive out of order
    for i in range(10):
        part = [(rng.randrange(4), seq, rng.choice(["update"] * 4 + ["delete"]), rng.choice([None, f"n{seq}"]), rng.choice([None, f"i{seq}"])) for seq in places[i * 6 : i * 6 + 6]]
        said = [(rng.randrange(3), i * 7 + j) for j in range(7)]
        rows, lines = rows + part, lines + said
        partial.write(spark.createDataFrame(part, schema), i)
        chat.write(spark.createDataFrame(said, "channel int, seq int"), i)
    want = {}
    for k, _, op, name, ip in sorted(rows, key=lambda r: r[1]):
        if op == "delete":
            want.pop(k, None)
        else:
            old = want.get(k, (None, None))
            want[k] = (name or old[0], ip or old[1])
    assert {r.k: (r.name, r.ip) for r in partial.current(spark).collect()} == want
    kept = [(c, s) for c in range(3) for s in sorted(s for d, s in lines if d == c)[-4:]]
    assert sorted(map(tuple, chat.current(spark).collect())) == kept and len(chat.log.manifest(spark).deltas) <= 4
