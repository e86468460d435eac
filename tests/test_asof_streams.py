import datetime
import random

import pytest

from sparkgauge.operators import asof, watch
from sparkgauge.sources.store import Store
from sparkgauge.streaming import captures

DAY = datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC)


def moment(hours):
    return None if hours is None else DAY + datetime.timedelta(hours=hours)


@pytest.mark.parametrize(("inclusive", "stretch"), [(False, 86_400), (True, 86_400), (False, 3_600 * 1_000), (True, 7_200)])
def test_latest_before(spark, inclusive, stretch):
    rng = random.Random(4)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    facts = [(key(), moment(rng.choice([None, *range(0, 400, 3)])), i % 17, rng.choice(["x", "y", None])) for i in range(300)]
    facts += facts[:20]
    asked = [(i, key(), moment(rng.choice([None, *range(-5, 420)])), "clash") for i in range(200)] + [(1, "nowhere", moment(5), None)] * 2

    def plain(k, at):
        found = [(t, n, (v is not None, v or "")) for f, t, n, v in facts if f is not None and f == k and t is not None and at is not None and (t <= at if inclusive else t < at)]
        return max(found)[1:] if found else (None, None)

    got = asof.latest_before(
        spark.createDataFrame(asked, "id long, k string, at timestamp, _part string"), spark.createDataFrame(facts, "k string, t timestamp, n long, v string"), ["k"], "at", "t", ("n", "v"), tie=("n",), inclusive=inclusive, stretch=stretch
    ).collect()
    want = [(i, k, at, c, n, v[1] if n is not None and v[0] else None) for i, k, at, c in asked for n, v in [plain(k, at)]]
    zone = lambda t: None if t is None else t.astimezone(datetime.UTC)
    assert sorted(map(str, [(r["id"], r["k"], zone(r["at"]), r["_part"], r["n"], r["v"]) for r in got])) == sorted(map(str, want))


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], "market string, snapshot_id string, snapshot_date date")
    asked = spark.createDataFrame([("M", datetime.date(2026, 1, 1))], "market string, as_of date")
    assert [r["snapshot_id"] for r in watch.snapshots_before(asked, none).collect()] == [None]
    assert watch.snapshots_before(asked.limit(0), none).count() == 0 and watch.latest_pair(none).count() == 0


def captured(n=120):
    rng = random.Random(8)
    return [(f"s{rng.randrange(3)}", DAY + datetime.timedelta(minutes=20 * i, microseconds=i), rng.choice(["one", "two", None])) for i in range(n)]


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, captures.CAPTURE).coalesce(1).write.mode("append").parquet(str(folder))


def status(rows):
    return sorted(map(str, [(r["watch_source_id"], r["captured_at"], r["previous_content_hash"], r["parse_status"]) for r in rows]))


def test_stream_waits_for_late_captures_and_is_restarted(spark, tmp_path):
    """Captures come out of order; the stream stops in the middle and goes on; a batch that runs again doubles nothing."""
    rows = captured()
    rng = random.Random(2)
    order = sorted(rows, key=lambda r: r[1] + datetime.timedelta(minutes=rng.randrange(50)))
    kept, folder = Store(spark, str(tmp_path / "store")), tmp_path / "in"

    def run():
        with captures.with_rocksdb(spark):
            captures.run_to_store(captures.ordered_changes(captures.read_captures(spark, str(folder), 1)), kept, "changes", str(tmp_path / "checkpoint"))

    before = spark.conf.get(captures.with_rocksdb.KEY, None)
    arrive(spark, folder, order[:40])
    run()
    assert spark.conf.get(captures.with_rocksdb.KEY, None) == before
    first = kept.read("changes").count()
    arrive(spark, folder, order[40:80])
    arrive(spark, folder, order[80:])
    run()
    batch = watch.captures(spark.createDataFrame(rows, captures.CAPTURE))
    # watermarks and timers are in whole milliseconds
    over = max(r[1] for r in rows).replace(microsecond=0) - datetime.timedelta(hours=1, milliseconds=1)
    want = [r for r in batch.collect() if r["captured_at"].astimezone(datetime.UTC) < over]
    assert 0 < first < len(want) and status(kept.read("changes").collect()) == status(want)
    # the last batch is lost and written again
    last = kept.read("changes").where(f"batch_id = {kept.read('changes').agg({'batch_id': 'max'}).first()[0]}").collect()
    kept.replace_slice("changes", spark.createDataFrame(last, kept.read("changes").schema), ["batch_id"])
    assert status(kept.read("changes").collect()) == status(want)


def test_captures_after_the_watermark_change_nothing(spark, tmp_path):
    rows = [("s", moment(h), text) for h, text in ((0, "one"), (10, "two"), (20, "two"))]
    kept, folder = Store(spark, str(tmp_path / "store")), tmp_path / "in"
    for part in (rows, [("s", moment(1), "other")], [("s", moment(30), "two"), ("s", moment(60), "x")]):
        arrive(spark, folder, part)
        with captures.with_rocksdb(spark):
            captures.run_to_store(captures.ordered_changes(captures.read_captures(spark, str(folder), 1)), kept, "changes", str(tmp_path / "checkpoint"))
    got = [(r["captured_at"].astimezone(datetime.UTC).hour if r["captured_at"] else None, r["parse_status"]) for r in kept.read("changes").where("parse_status <> 'late'").orderBy("captured_at").collect()]
    assert got == [(0, "changed"), (10, "changed"), (20, "unchanged"), (6, "unchanged")]


def test_what_waits_is_read_once_a_batch():
    """A thousand waiting captures of a source need one timer, and one reading of the state when it is over."""
    import json

    import pandas as pd

    from sparkgauge.streaming.captures import _Ordered

    class Value:
        held, reads = None, 0

        def exists(self):
            return self.held is not None

        def get(self):
            self.reads += 1
            return self.held

        def update(self, v):
            self.held = v

        def clear(self):
            self.held = None

    class Handle:
        def __init__(self):
            self.timers, self.last, self.waiting = [], Value(), Value()

        def getValueState(self, name, _):  # noqa: N802
            return getattr(self, name)

        def registerTimer(self, at):  # noqa: N802
            self.timers.append(at)

    class Now:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.at

        getExpiryTimeInMs = getCurrentWatermarkInMs

    handle, state = Handle(), _Ordered()
    state.init(handle)
    at = pd.to_datetime(range(1000), unit="s")
    assert not list(state.handleInputRows(("w",), iter([pd.DataFrame({"captured_at": at[::-1], "content_hash": ["a"] * 1000})]), Now(0)))
    assert handle.timers == [0]
    out = pd.concat(state.handleExpiredTimer(("w",), Now(900_000), Now(0)))
    assert list(out["captured_at"]) == list(at[:900]) and handle.waiting.reads == 1
    assert list(out["parse_status"]) == ["changed", *["unchanged"] * 899]
    assert len(json.loads(handle.waiting.held[0])) == 100 and handle.timers == [0, 900_000]
