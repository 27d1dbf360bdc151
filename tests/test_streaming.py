import hashlib
import os
import random
from collections import Counter

import pytest

from arbolex.operators import series as se
from arbolex.streaming import source as sr
from arbolex.streaming import state as ss
from arbolex.streaming import text as stx
from tests.test_models import plain_running


def arrive(folder, name, lines):
    (folder / name).write_text("".join(line + "\n" for line in lines), encoding="utf-8")


def test_batches_over_several_epochs_equal_one_replay(spark, tmp_path):
    rng = random.Random(3)
    lines = [" ".join("w" for _ in range(rng.choice([2, 2, 2, 3, 5]))) + f" {i}" for i in range(200)]
    folder, path = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for k in range(4):
        arrive(folder, f"{k}.txt", lines[k * 50 : (k + 1) * 50])
        tokens = stx.stream_tokens(stx.stream_lines(spark, str(folder)))
        rows = ss.stream_batches(tokens, path, 7).collect()
    want = Counter(len(x.split()) + 2 for x in lines)
    got = Counter(r.seq_len for r in rows)
    assert got == {k: v // 7 * 7 for k, v in want.items() if v >= 7}
    for length in got:
        order = [x for x in lines if len(x.split()) + 2 == length][: got[length]]
        mine = sorted((r for r in rows if r.seq_len == length), key=lambda r: (r.epoch, r.batch_no, r.slot))
        assert [r.line for r in mine] == order


def test_running_loss_stream_continues(spark, tmp_path):
    xs = [float((i * 31) % 97) for i in range(330)]
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "series string, ord long, loss double"
    for lo, hi in ((0, 60), (60, 250), (250, 330)):
        rows = [("s", i, xs[i]) for i in range(lo, hi)] + ([("once", 0, 5.0)] if lo == 0 else [])
        spark.createDataFrame(rows, schema).write.mode("append").parquet(folder)
        out = ss.stream_running_loss(spark.readStream.schema(schema).parquet(folder), path, se.WARM, se.DECAY)
    got = sorted((r for r in out.collect() if r.series == "s"), key=lambda r: r.k)
    want = plain_running(xs, 100, 0.99)
    assert len(got) == 330 and all(abs(r.avg_loss - w) < 1e-9 for r, w in zip(got, want))
    assert out.where("series = 'once'").count() == 1


def test_streamed_counts_and_tokens(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    arrive(folder, "a.txt", ["x y", "x"])
    arrive(folder, "b.txt", ["y y z"])
    lines = stx.stream_lines(spark, str(folder), files_per_trigger=1)
    counts = {r.word: r.n for r in stx.word_count_table(lines).collect()}
    assert counts == {"x": 2, "y": 3, "z": 1}
    assert sorted(r.n for r in stx.tokens_table(lines).collect()) == [1, 2, 3]


def files(folder, **texts):
    for name, lines in texts.items():
        (folder / f"{name}.txt").write_text("\n".join(lines))


def collector(sizes, rows):
    def write(df, epoch):
        got = df.collect()
        sizes[epoch] = len(got)
        rows.extend((r.file.rsplit("/", 1)[-1], r.line_no, r.line) for r in got)

    return write


def test_triggers_take_lines_by_count_and_go_on_inside_a_file(spark, tmp_path):
    folder, check = tmp_path / "in", str(tmp_path / "check")
    folder.mkdir()
    texts = {"a": [f"a é {i}" for i in range(1_250)], "b": [f"b {i}" for i in range(400)]}
    files(folder, **texts)
    sizes, rows = {}, []

    def go_on():
        sr.drain_triggers(sr.stream_line_counts(spark, str(folder), [1000, 100, 300], check), check, collector(sizes, rows))

    go_on()
    assert sizes == {0: 1000, 1: 100, 2: 300, 3: 250}
    files(folder, c=["c"] * 650)
    texts["c"] = ["c"] * 650
    go_on()  # a new query with the old checkpoint
    assert [sizes[e] for e in (4, 5, 6)] == [300, 300, 50]
    assert sorted(rows) == sorted((f"{name}.txt", i, line) for name, lines in texts.items() for i, line in enumerate(lines, 1))


def test_a_stopped_query_loses_and_repeats_nothing(spark, tmp_path):
    folder, check = tmp_path / "in", str(tmp_path / "check")
    folder.mkdir()
    files(folder, a=[f"{i}" for i in range(900)])
    sizes, rows, fail = {}, [], [2]
    keep = collector(sizes, rows)

    def write(df, epoch):
        if epoch in fail:
            fail.remove(epoch)
            raise RuntimeError("lost")
        keep(df, epoch)

    lines = lambda: sr.stream_line_counts(spark, str(folder), [200], check)
    with pytest.raises(Exception, match="lost"):
        sr.drain_triggers(lines(), check, write)
    sr.drain_triggers(lines(), check, write)
    assert sizes == {0: 200, 1: 200, 2: 200, 3: 200, 4: 100}
    assert [r[2] for r in sorted(rows, key=lambda r: r[1])] == [str(i) for i in range(900)]


def test_long_lines_are_passed_over_and_not_counted(spark, tmp_path, monkeypatch):
    folder, check = tmp_path / "in", str(tmp_path / "check")
    folder.mkdir()
    files(folder, a=["x y z"] * 5 + ["x"] * 20 + [""] * 3)
    sizes, rows = {}, []
    sr.drain_triggers(sr.stream_line_counts(spark, str(folder), [10], check, longest=2), check, collector(sizes, rows))
    assert sizes == {0: 10, 1: 10, 2: 3 - 1}  # a line feed at the very end opens no line
    assert {r[1] for r in rows} == set(range(6, 28))


def replay(lines, intake, size, ready, seed=4):
    """Batches by draw and leftovers, one line after the other."""
    buckets, draws, epoch, at = {}, [], 0, 0

    def draw(full):
        pick = full[int(hashlib.md5(f"{len(draws)}:{seed}".encode()).hexdigest()[:8], 16) % len(full)]
        draws.append([buckets[pick].pop(0) for _ in range(size)])

    def full():
        return sorted(n for n, b in buckets.items() if len(b) >= size)

    while at < len(lines):
        n = intake[min(epoch, len(intake) - 1)]
        for line in lines[at : at + n]:
            buckets.setdefault(len(line.split()) + 2, []).append(line)
        at += n
        if epoch and full():
            draw(full())
        while len(full()) >= ready:
            draw(full())
        epoch += 1
    while full():
        draw(full())
    return draws, sorted(x for b in buckets.values() for x in b)


def test_draws_equal_a_replay(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [f"{i}" + " w" * ((i * i + i // 7) % 9) for i in range(400)]
    files(folder, a=lines[:150], b=lines[150:])
    batches, left = ss.stream_draws(spark, str(folder), str(tmp_path / "state"), [120, 20, 60], size=4, ready=6)
    want, rest = replay(lines, [120, 20, 60], 4, 6)
    got = {}
    for r in batches.collect():
        assert len(r.words) + 2 == r.seq_len
        got.setdefault(r.draw, {})[r.slot] = r.line
    assert [[got[d][s] for s in range(4)] for d in range(len(want))] == want and len(got) == len(want)
    assert sorted(r.line for r in left.collect()) == rest


def test_draws_of_an_empty_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    batches, left = ss.stream_draws(spark, str(tmp_path / "in"), str(tmp_path / "state"), [10])
    assert batches.count() == 0 and left.count() == 0


def test_counts_are_merged_every_so_many_epochs(spark, tmp_path):
    folder, path = tmp_path / "in", str(tmp_path / "counts")
    folder.mkdir()
    want = Counter()
    for part in range(5):
        lines = [" ".join(f"w{(part * i) % 7}" for i in range(9)), f"only{part}"]
        want.update(" ".join(lines).split())
        arrive(folder, f"{part}.txt", lines)
        stream = stx.stream_lines(spark, str(folder), 1)
        assert {r.word: r.n for r in stx.word_count_table(stream, path, every=2).collect()} == want
    merged = sorted(p.name for p in (tmp_path / "counts" / "merged").iterdir())
    assert merged == ["1", "3"]


def test_batches_are_cut_without_a_shuffle_of_lines(spark, tmp_path):
    """Lines of one length from many stretches of files keep their order, and none crosses an exchange."""
    lines = [f"{'w ' * (i % 3)}{i}" for i in range(400)]
    folder, path = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for k in range(8):
        arrive(folder, f"{k}.txt", lines[k * 50 : (k + 1) * 50])
        os.utime(folder / f"{k}.txt", (1000 + k, 1000 + k))  # the order of files in a stream
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")  # a file has several stretches
    names, small = [], ss.if_small
    try:
        ss.if_small = lambda df, *a: names.append(df.columns) or small(df, *a)
        tokens = stx.stream_tokens(stx.stream_lines(spark, str(folder), 3))
        rows = ss.stream_batches(tokens, path, 7).collect()
    finally:
        ss.if_small = small
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    # what is joined to the lines is a table of stretches and lengths, in each of the three epochs
    assert len(names) == 3 and all("line" not in columns and "words" not in columns for columns in names)
    for length in (3, 4, 5):
        want = [x for x in lines if len(x.split()) + 2 == length]
        mine = sorted((r for r in rows if r.seq_len == length), key=lambda r: (r.epoch, r.batch_no, r.slot))
        assert [r.line for r in mine] == want[: len(want) // 7 * 7]
        assert all(r.words == r.line.split() for r in mine)
