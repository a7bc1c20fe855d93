from starfold.operators.assemble import (  # noqa: F401
    align,
    anti,
    assemble,
    attach,
    attach_spread,
    hot_keys,
    matching,
    stack_rows,
    unique_rows,
)
from starfold.operators.blocks import FeatureBlock  # noqa: F401
from starfold.operators.encode import (  # noqa: F401
    append_codes,
    category_counts_long,
    category_vectors,
    codebook,
    dictionary_encode,
    first_seen_values,
    one_hot,
    vocabulary,
    wide_category_counts,
)
from starfold.operators.profile import base_rate, coverage, distinct_ids, observed  # noqa: F401
from starfold.operators.scale import (  # noqa: F401
    fill_truncated_mean,
    fill_truncated_min,
    log_scale,
    log_stats,
    scale_by_max,
)
from starfold.operators.sketch import distinct_sketches, estimates, merge_sketches  # noqa: F401
from starfold.operators.split import (  # noqa: F401
    exact_folds,
    exact_split,
    hash_fold,
    hash_split,
    hash_text,
    stratified_holdout,
)
from starfold.operators.states import StateBlock, StateStore  # noqa: F401
