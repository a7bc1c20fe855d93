from starfold.functions.aggregates import (  # noqa: F401
    biggest,
    carry_first,
    carry_latest,
    category_counts,
    category_shares,
    dummy_name,
    earliest,
    flag_rate,
    latest,
    mean_of,
    order_key,
    present,
    row_count,
    share_where,
    total_of,
    truncated_mean,
    year_span,
)
from starfold.functions.nulls import (  # noqa: F401
    fill_constant,
    fill_from,
    fill_numeric,
    replace_value,
)
from starfold.functions.scalars import (  # noqa: F401
    date_piece,
    decision,
    flag,
    log_bin,
    log1p_or_null,
    parse_amount,
    probability_text,
    ratio,
    round_half_even,
    scaled_down,
)
