"""Run profile shared by fitting and prediction, and the fixed constants of the workflow."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Fixed values of the workflow: 80 / 20 stratified split with seed 42, threshold 0.5 (strict),
# sequence length 128 (256 when evaluating the second data set), batches of 16,
# head width 128, dropout 0.3, AdamW learning rate 2e-5.
SEED = 42
TEST_SHARE = 0.2
THRESHOLD = 0.5
MAX_LEN = 128
MAX_LEN_LONG = 256
BATCH_SIZE = 16
HEAD_WIDTH = 128
DROPOUT = 0.3
LEARNING_RATE = 2e-5

# Special token ids of our own vocabulary (ids of real tokens start after these).
PAD_ID, UNK_ID, START_ID, END_ID = 0, 1, 2, 3
N_SPECIAL = 4

CLEAN_PROFILES = ("strong", "light", "raw")


@dataclass(frozen=True)
class Profile:
    """Everything that must be the same when a model is fitted and when it is applied."""

    clean: str = "strong"
    max_len: int = MAX_LEN
    threshold: float = THRESHOLD
    seed: int = SEED
    test_share: float = TEST_SHARE

    def __post_init__(self):
        if self.clean not in CLEAN_PROFILES:
            raise ValueError(f"unknown cleaning profile {self.clean!r}; use one of {CLEAN_PROFILES}")
        if self.max_len < 2:
            raise ValueError("max_len must leave room for the start and end ids")
        if not 0.0 < self.test_share < 1.0:
            raise ValueError("test_share must be in (0, 1)")

    def with_(self, **kw) -> "Profile":
        return replace(self, **kw)

    def check_same(self, other: "Profile") -> None:
        """A model fitted under one profile must not be applied under another."""
        if (self.clean, self.max_len) != (other.clean, other.max_len):
            raise ValueError(f"profile mismatch: fitted with {self}, applied with {other}")


DEFAULT_PROFILE = Profile()
