import pytest

from millrace import kl_divergence_from_logits
from millrace.operators.align import align_tokens


def frame(spark, positions, name):
    return spark.createDataFrame([(0, p, [float(p), 1.0]) for p in positions], f"batch_id long, pos int, {name} array<double>")


def test_align(spark):
    both = align_tokens(frame(spark, [0, 1], "student"), frame(spark, [1, 0], "teacher"))
    assert both.columns == ["batch_id", "pos", "student", "teacher"]
    assert [r.kl for r in kl_divergence_from_logits(both).collect()] == pytest.approx([0, 0])


@pytest.mark.parametrize(("left", "right"), [([0], [0, 1]), ([0, 1], [1]), ([], [0])])
def test_missing_positions_fail(spark, left, right):
    with pytest.raises(Exception, match="same shape"):
        align_tokens(frame(spark, left, "student"), frame(spark, right, "teacher")).count()


def test_clashing_names(spark):
    with pytest.raises(ValueError, match="both frames"):
        align_tokens(frame(spark, [0], "student"), frame(spark, [0], "student"))
