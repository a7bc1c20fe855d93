from starfold.sources.bucketed import bucketed, store_bucketed  # noqa: F401
from starfold.sources.readers import (  # noqa: F401
    Checked,
    read_csv,
    read_csv_checked,
    read_parquet,
    read_star,
    reject_count,
    table,
)
from starfold.sources.schemas import STAR_FILES, STAR_SCHEMAS  # noqa: F401
from starfold.sources.sinks import (  # noqa: F401
    write_feature_map,
    write_feature_map_atomic,
    write_importance,
    write_importance_atomic,
    write_scored,
    write_scored_atomic,
)
from starfold.sources.versions import Conflict, Versions, committed_path, write_committed  # noqa: F401
