from starfold.plans.company import (  # noqa: F401
    BASE,
    CARRY,
    RECIPES,
    STACKED,
    WIDE,
    Recipe,
    company_matrix,
    feature_names,
    pin_values,
)
