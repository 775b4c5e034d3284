"""Evidence at the bound to the last digit."""

from quarry.plans.further import evidence_sufficiency


class Tables:
    def __init__(self, conversations):
        self.conversations = conversations


def test_values_are_added_by_turn(spark):
    """whatever order rows come in, a conversation's values are added by turn, as in SQL."""
    lengths = [32, 15, 63, 97, 43]
    ordered = 0.0
    for n in lengths:
        ordered += n / 100.0
    want = 0.72 * (5 / 8.0) + 0.16 * (ordered / 5) + 0.12 >= 0.65
    orders = [[0, 1, 2, 3, 4], [4, 3, 2, 1, 0], [0, 1, 2, 4, 3], [3, 4, 0, 2, 1]]
    rows = [(c, k, "user" if k % 2 else "assistant", "x" * lengths[k]) for c, order in enumerate(orders) for k in order]
    got = evidence_sufficiency(Tables(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1))).collect()
    assert [r["sufficient"] for r in got] == [want] * 4
