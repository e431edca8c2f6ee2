"""Job parameters and their validation."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# The default topic list. Its order decides ties between equally likely topics.
DEFAULT_TOPICS = (
    "News",
    "Research",
    "Technology",
    "Travel",
    "Personal",
    "Education",
    "Career",
    "Health",
    "Sports",
    "Vacation",
    "Movie",
    "Entertainment",
    "Book",
    "Event",
    "Food",
    "Politics",
    "Finance",
    "Relationships",
    "Religion",
    "Immigration",
    "Fantasy",
)

# The scoring modes a run may name.
AUTO = "auto"
BASELINE = "st_baseline"
MIXED = "jina_mixed"
BAG_OF_WORDS = "jina_bag_of_words"
FULL_TEXT = "jina_full_text"
HYBRID = "hybrid"
MODES = (AUTO, BASELINE, MIXED, BAG_OF_WORDS, FULL_TEXT, HYBRID)

REMOTE_PROVIDER = "jina"
DEFAULT_THRESHOLD = 0.07
DEFAULT_TOP_KEYWORDS = 20


def parse_topics(text: str) -> tuple[str, ...]:
    """Comma separated topic names, trimmed, order kept."""
    return tuple(part.strip() for part in text.split(","))


def resolve_mode(mode: str, provider: str) -> str:
    """`auto` depends on the provider; every other mode stands for itself."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}, expected one of {MODES}")
    if mode != AUTO:
        return mode
    return MIXED if provider == REMOTE_PROVIDER else BASELINE


def default_run_name(provider: str, threshold: float, stamp: str) -> str:
    return f"{provider}_t{threshold}_{stamp}"


@dataclass(frozen=True)
class RunParams:
    """Parameters of one analysis run. Instances are always valid; change one with `with_`."""

    topics: tuple[str, ...] = DEFAULT_TOPICS
    threshold: float = DEFAULT_THRESHOLD
    provider: str = "hash"
    model: str | None = None
    mode: str = AUTO
    use_keywords: bool = True
    keyword_model: str | None = None
    top_keywords: int | None = DEFAULT_TOP_KEYWORDS
    prefilter: float = 0.0
    start_date: str | None = None
    end_date: str | None = None
    spell_check: bool = False
    lemmatize: bool = True
    null_text: str | None = None
    labelled_set: str | None = None
    stop_words: tuple[str, ...] | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        if not self.topics:
            raise ValueError("at least one topic is needed")
        if not 0.0 < self.threshold < 1.0:
            raise ValueError("threshold must lie strictly between 0 and 1")
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}, expected one of {MODES}")

    def with_(self, **changes) -> "RunParams":
        """A changed copy; None leaves a value alone, and the result is validated again."""
        return replace(self, **{k: v for k, v in changes.items() if v is not None})

    @property
    def scoring_mode(self) -> str:
        return resolve_mode(self.mode, self.provider)

    @property
    def is_selective(self) -> bool:
        """False when a text without any evidence (uniform 1/T) already passes the threshold."""
        return self.threshold > 1.0 / len(self.topics)

    @property
    def fingerprint(self) -> str:
        """Everything accuracy depends on, the labelled set included."""
        parts = [
            self.provider,
            self.model,
            self.use_keywords,
            self.keyword_model,
            ",".join(sorted(self.topics)),
            self.spell_check,
            self.lemmatize,
            self.mode,
        ]
        if self.labelled_set is not None:
            parts.append(self.labelled_set)
        return "|".join(str(p) for p in parts)
