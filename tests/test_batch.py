import threading

from vellumspark.batch import Control, run_batches


def test_a_failed_batch_does_not_stop_the_others(spark):
    seen = []

    def work(name):
        if name == "b":
            raise ValueError("no lines")
        assert spark.range(5).count() == 5

    out = run_batches(spark, ["a", "b", "c"], work, progress=lambda *x: seen.append(x))
    assert out.done == ["a", "c"] and out.failed == {"b": "ValueError: no lines"} and not out.cancelled
    assert seen == [(1, 3, "a", "COMPLETED"), (2, 3, "b", "FAILED"), (3, 3, "c", "COMPLETED")]
    assert [tuple(r) for r in out.errors(spark).collect()] == [("b", "ValueError: no lines")]
    assert run_batches(spark, [], work).done == []


def test_cancelling_stops_and_pausing_waits(spark):
    control, ran = Control(spark), []

    def work(name):
        ran.append(name)
        if name == "b":
            control.cancel()

    out = run_batches(spark, ["a", "b", "c"], work, control)
    assert out.cancelled and ran == ["a", "b"] and out.done == ["a"]
    control, ran = Control(spark), []
    control.pause()
    t = threading.Thread(target=lambda: run_batches(spark, ["a"], ran.append, control))
    t.start()
    t.join(0.3)
    assert ran == [] and t.is_alive()
    control.resume()
    t.join(10)
    assert ran == ["a"]
