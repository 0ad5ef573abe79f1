"""Plan shapes that keep the operators distributed whatever the key distribution."""

from tillsight.plans.distincts import distinct_by_group, distinct_count_by
from tillsight.plans.eager import counts_by_key, roll_up
from tillsight.plans.materialize import drop_materialized, materialize, new_path
from tillsight.plans.pairs import distinct_lines, pair_counts, top_label_pairs
from tillsight.plans.ranks import dense_rank_top, first_n, share_of_total
from tillsight.plans.tiles import exact_tiles

__all__ = [
    "counts_by_key",
    "dense_rank_top",
    "distinct_by_group",
    "distinct_count_by",
    "distinct_lines",
    "drop_materialized",
    "exact_tiles",
    "first_n",
    "materialize",
    "new_path",
    "pair_counts",
    "roll_up",
    "share_of_total",
    "top_label_pairs",
]
