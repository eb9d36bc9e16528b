"""Settings of a run. Driver-side only; never a DataFrame."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

# The levels and kinds that tables may hold.
DIFFICULTIES = ("easy", "medium", "hard")
SEVERITIES = ("low", "medium", "high")
FAILURE_TYPES = ("missing_evidence", "context_noise", "chunk_boundary", "evidence_position", "conflict", "hard_negative")
STAGE_OF = {"missing_evidence": "evidence", "context_noise": "context", "chunk_boundary": "chunking", "evidence_position": "context", "conflict": "context", "hard_negative": "retrieval"}
SEVERITY_DIFFICULTY = {"low": 0.25, "medium": 0.50, "high": 0.75}
ANSWER_TYPES = ("person", "organization", "location", "date", "numeric", "other")
ABSTAIN_MARKERS = (
    "i don't know", "i do not know", "cannot answer", "can't answer", "not enough information", "no information",
    "insufficient information", "unable to answer", "not mentioned", "not provided", "not stated",
)


# Fixed values, from here to the run's own: the defaults of each section.
@dataclass(frozen=True)
class Filtering:
    exclude_redirects: bool = True
    exclude_disambiguation: bool = True
    exclude_lists: bool = True
    exclude_timelines: bool = True
    min_page_chars: int = 2000
    min_sections: int = 2
    min_prose_ratio: float = 0.55
    max_paragraph_repeat_ratio: float = 0.35


@dataclass(frozen=True)
class Chunking:
    chunk_tokens: int = 300
    overlap_tokens: int = 0
    least_tokens: int = 5
    split_order: tuple[str, ...] = ("section", "paragraph", "sentence", "token")


@dataclass(frozen=True)
class Generation:
    target_candidates: int = 1000
    min_chunk_tokens: int = 60
    max_chunk_tokens: int = 320
    max_candidate_chunks: int = 2000
    skip_lead_sections: bool = False
    quotas: dict[str, float] = field(default_factory=lambda: {"easy": 0.40, "medium": 0.40, "hard": 0.20})
    prompt_version: str = "qa_v2_difficulty"
    temperature: float = 0.2
    max_tokens: int = 512
    enforce_target_difficulty: bool = True


@dataclass(frozen=True)
class Validation:
    min_question_chars: int = 12
    max_question_tokens: int = 60
    require_answer_containment: bool = True
    require_evidence_containment: bool = True
    require_baseline_correct: bool = True
    use_answerability_judge: bool = True
    use_baseline_test: bool = True
    min_judge_confidence: float = 0.6
    min_quality_score: float = 0.85
    target_clean_seeds: int = 200
    near_duplicate_threshold: float = 0.85


@dataclass(frozen=True)
class Failures:
    types: tuple[str, ...] = FAILURE_TYPES
    severities: tuple[str, ...] = SEVERITIES
    noise_ratios: dict[str, float] = field(default_factory=lambda: {"low": 0.25, "medium": 0.50, "high": 0.75})
    context_budget: int = 8
    use_verification_judge: bool = False


@dataclass(frozen=True)
class Evaluation:
    temperature: float = 0.0
    max_tokens: int = 256
    use_llm_judge: bool = True


@dataclass(frozen=True)
class Run:
    """All settings of one run; ``seed`` keys every sample."""

    run_id: str = "run"
    seed: int = 42
    categories: dict[str, int] = field(default_factory=lambda: {"de": 100, "en": 200, "es": 100, "fr": 100})
    filtering: Filtering = Filtering()
    chunking: Chunking = Chunking()
    generation: Generation = Generation()
    validation: Validation = Validation()
    failures: Failures = Failures()
    evaluation: Evaluation = Evaluation()
    abstain_markers: tuple[str, ...] = ABSTAIN_MARKERS

    def __post_init__(self):
        if not self.categories:
            raise ValueError("at least one category is needed")
        if any(q < 1 for q in self.categories.values()):
            raise ValueError("category quotas are 1 or more")

    def with_seed(self, seed: int, prefix: str = "run_s") -> Run:
        """The same settings for another seed of a stability study."""
        return replace(self, seed=seed, run_id=f"{prefix}{seed}")

    def to_dict(self) -> dict:
        return asdict(self)


def load(path: str) -> Run:
    """Read settings from a YAML or JSON file with the sections named as the fields of Run."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml

        data = yaml.safe_load(text)
    except ImportError:
        import json

        data = json.loads(text)
    parts = {"filtering": Filtering, "chunking": Chunking, "generation": Generation, "validation": Validation, "failures": Failures, "evaluation": Evaluation}
    made = {}
    for name, value in (data or {}).items():
        if name in parts:
            value = parts[name](**{k: tuple(v) if isinstance(v, list) else v for k, v in value.items()})
        made[name] = tuple(value) if isinstance(value, list) else value
    return Run(**made)
