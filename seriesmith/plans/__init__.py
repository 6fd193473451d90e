import importlib

MODULES = ("q_sources", "q_clean", "q_profile", "q_columns", "q_joins", "q_aggregate", "q_functions", "q_trend", "q_calibrate",
           "q_response", "q_compare", "q_products", "q_levels", "q_streaming")


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
