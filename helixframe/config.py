"""Job options as frozen dataclasses (only those that shape data)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field


@dataclass(frozen=True)
class CorpusOptions:
    """Corpus preparation: tokenise, pad, shuffle, mask, batch."""

    max_length: int = 512
    pad_id: int = 0
    shuffle_buffer: int = 5000
    train_batch_size: int = 128
    valid_batch_size: int = 128
    gradient_accumulation_steps: int = 2
    mlm_probability: float = 0.15
    max_eval_steps: int = -1  # no cap
    seed: int = 1

    def effective_buffer(self) -> int:
        """The shuffle buffer holds whole optimizer steps; otherwise it becomes five of them."""
        rows_per_step = self.train_batch_size * self.gradient_accumulation_steps
        if self.shuffle_buffer % rows_per_step == 0:
            return self.shuffle_buffer
        return 5 * rows_per_step


@dataclass(frozen=True)
class NearDuplicateOptions:
    """Near duplicates by banded MinHash; a band of a sketch holds ``rows`` least hashes."""

    threshold: float = 0.85
    k: int = 21  # letters of a k-mer, 29 at most
    bands: int = 16
    rows: int = 5
    seed: int = 1
    leader_rounds: int = 4  # at most
    small_bucket: int = 64  # sets of a bucket that is not split further
    splits: int = 3  # classes of sizes, in larger buckets, to a step of the threshold


@dataclass(frozen=True)
class WindowOptions:
    """Windows of genome sequences."""

    width: int = 512
    stride: int = 256
    keep_rest: bool = True  # a last window that is shorter
    windows_per_block: int = 4096
    windows_per_task: int = 1 << 20


@dataclass(frozen=True)
class QualityOptions:
    """Limits of a text's line and character statistics.

    The fraction is that of alphanumeric characters, and less than ``alnum_fraction`` is too little: the usual reading of a
    limit whose description speaks of the other characters.
    """

    line_max: float = 1000
    line_mean: float = 100
    alnum_fraction: float = 0.25
    token_ratio: float = 1.5


@dataclass(frozen=True)
class FoldOptions:
    """Cross-validated evaluation."""

    folds: int = 10
    seed: int = 123
    select_by: str = "mcc"


@dataclass(frozen=True)
class EarlyStopOptions:
    patience: int = 5
    threshold: float = 0.01


@dataclass(frozen=True)
class LogOptions:
    """Training-log roll-up."""

    gradient_accumulation_steps: int = 2
    save_checkpoint_steps: int = 1000
    train_batch_size: int = 128
    processes: int = 4


@dataclass(frozen=True)
class ReportNames:
    """The model names in a set of score files; they belong to the study, not to the library.

    ``prefix`` starts the name of each own model; ``excluded`` models stay out of the
    overall table; each slice lists (model, display name) pairs in display order;
    ``variants`` gives the display name of each continued-training variant; models
    ending in ``loan_suffix`` use the tokenizer of ``lender``.
    """

    prefix: str
    excluded: Sequence[str] = ()
    slices: Mapping[str, Sequence[tuple[str, str]]] = field(default_factory=dict)
    variants: Mapping[str, str] = field(default_factory=dict)
    loan_suffix: str = "-at-base-nt"
    lender: str = ""
