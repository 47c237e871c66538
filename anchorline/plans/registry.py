"""The tools that pipelines may name: an explicit list, so that no text of a configuration is looked up as code."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from anchorline.operators import combine, develop, parse, preparation, transform
from anchorline.sources import files

_PALETTES = {
    "InOut": (files, "input_data output_data text_input browse directory date_time_now"),
    "Preparation": (preparation, "filter formula select data_cleansing sort unique sample record_id generate_rows auto_field multi_field_formula multi_row_formula tile imputation create_samples date_filter oversample_field rank"),
    "Join": (combine, "join join_multiple union find_replace append_fields fuzzy_match make_group"),
    "Transform": (transform, "summarize transpose cross_tab running_total count_records arrange make_columns weighted_average"),
    "Parse": (parse, "date_time regex_match regex_parse regex_replace regex_tokenize text_to_columns xml_parse"),
    "Developer": (develop, "base64_encode base64_decode download column_info dynamic_rename json_parse dynamic_select test test_equal"),
}
TOOLS: dict[str, Callable] = {f"{p}.{n}": getattr(module, n) for p, (module, names) in _PALETTES.items() for n in names.split()}
#: Tools that act at once; all others only plan.
SINKS = {"InOut.output_data", "InOut.browse", "Developer.test", "Developer.test_equal"}


def tool(name: str) -> Callable:
    if name not in TOOLS:
        raise ValueError(f"Could not find tool {name!r}")
    return TOOLS[name]


def takes_many(name: str) -> bool:
    """Whether the tool takes any number of frames."""
    return any(p.kind is p.VAR_POSITIONAL for p in inspect.signature(tool(name)).parameters.values())


def parameters(name: str) -> dict[str, inspect.Parameter]:
    return dict(inspect.signature(tool(name)).parameters)
