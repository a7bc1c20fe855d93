from starfold.models.boosting import (  # noqa: F401
    DEPTH_SIX,
    DEPTH_SIX_STACKED,
    FEW_LEAVES,
    MANY_LEAVES,
    BoostedClassifier,
    BoostSettings,
    best_round,
    feature_vector,
    positive_probability,
    prefix_model,
    round_metrics,
)
from starfold.models.evaluate import (  # noqa: F401
    area_under_roc,
    areas_under_roc,
    feature_map,
    gain_importance,
    kept_rounds,
    metric_history,
    split_importance,
    top_features,
)
from starfold.models.persist import Boosted, BoostedModel, Stacked, StackedModel  # noqa: F401
from starfold.models.stack import Stack, blend_frames, out_of_fold  # noqa: F401
from starfold.models.submit import submission  # noqa: F401
