"""String functions over model, dataset and file names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def replace_in_order(text: Column, steps: Sequence[tuple[str, str]]) -> Column:
    """Literal replacements, each applied to the outcome of the one before."""
    for old, new in steps:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def sentence_case(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substr(text, F.lit(2))))


def clean_dataset_name(name: Column) -> Column:
    """Display form of a dataset name: spaces, short splice names, sentence case.

    Histone mark names (leading ``H``) keep their case.
    """
    spaced = replace_in_order(
        name,
        [
            ("_", " "),
            ("splice sites donors", "donors"),
            ("splice sites acceptors", "acceptors"),
            ("splice sites all", "all"),
        ],
    )
    cased = F.when(spaced.startswith("H"), spaced).otherwise(sentence_case(spaced))
    return replace_in_order(cased, [("no tata", "(no TATA)"), ("types", "(types)")])


def task_group(dataset: Column) -> Column:
    """Task family by name prefix; NULL stays NULL."""
    return (
        F.when(dataset.isNull(), F.lit(None).cast("string"))
        .when(dataset.startswith("H"), "Chromatin profiles")
        .when(dataset.startswith("enhan") | dataset.startswith("promo"), "Regulatory elements")
        .when(dataset.startswith("spli"), "Splicing")
        .otherwise("Genome origin")
    )


def nth_part(text: Column, separator: str, index: int) -> Column:
    """The ``index``-th part counted from 0, NULL where there are fewer parts."""
    return F.get(F.split(text, f"\\Q{separator}\\E"), F.lit(index))


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """Regex extract that gives NULL, not an empty string, without a match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def model_family(model: Column, prefix: str) -> Column:
    """Architecture by name; ``prefix`` starts the name of each own model, others are NT."""
    return (
        F.when(model.isNull(), F.lit(None).cast("string"))
        .when(~model.startswith(prefix), "NT")
        .when(model.contains("esm"), "ESM")
        .otherwise("DeBERTa")
    )


def model_size_million(model: Column, prefix: str) -> Column:
    """Two or three digits in front of ``M`` in the size part of a model name, as double."""
    family = model_family(model, prefix)
    size_part = (
        F.when(family == "DeBERTa", nth_part(model, "_", 3))
        .when(family == "ESM", nth_part(model, "_", 4))
        .otherwise(F.upper(nth_part(model, "-", 3)))
    )
    return safe_double(first_match(size_part, r"^\d{2,3}(?=M)"))


def model_vocab_size(model: Column, prefix: str) -> Column:
    family = model_family(model, prefix)
    part = (
        F.when(family == "DeBERTa", nth_part(model, "_", 1))
        .when(family == "ESM", nth_part(model, "_", 2))
        .when(family == "NT", F.lit("4096"))
    )
    return safe_double(part)


def safe_double(text: Column) -> Column:
    """Number in the text, NULL if it is not one."""
    return text.try_cast("double")


def last_path_part(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_replace(last_path_part(path), r"\.[^.]*$", "")


def step_from_name(name: Column) -> Column:
    """``step_123`` as 123, NULL for any other name."""
    return F.regexp_extract(name, r"^step_(\d+)$", 1).try_cast("bigint")


def tokenizer_source(model: Column, loan_suffix: str, lender: str) -> Column:
    """Model whose tokenizer is used: those with the suffix borrow the lender's."""
    return F.when(model.endswith(loan_suffix), F.lit(lender)).otherwise(model)


def result_file_name(model: Column, dataset: Column, lora: Column | None = None) -> Column:
    name = F.concat(model, F.lit("_results_"), dataset)
    if lora is None:
        return name
    return F.concat(F.when(lora, "lora_32_8_").otherwise(""), name)


def percent(value: Column, digits: int) -> Column:
    """``0.1234`` as ``12.3%`` (one digit)."""
    return F.format_string(f"%.{digits}f%%", value * 100.0)


def fixed_point(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", value)


def alias(name: Column, names: Mapping[str, str]) -> Column:
    """Display name from a short fixed map; names outside it stay."""
    return F.coalesce(F.try_element_at(literal_map(names), name), name)


def literal_map(entries: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])
