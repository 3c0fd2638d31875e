"""Settings of the operators, checked when they are made; their values become literals in the plans."""

import math
from dataclasses import dataclass, field, fields

STRATEGIES = ("hybrid", "score_only", "uniform")
INFINITE = float("inf")


def within(default, low=-INFINITE, high=INFINITE, above: bool = False):
    """A field with the bounds of its values; above: the low end itself is not allowed."""
    return field(default=default, metadata={"low": low, "high": high, "above": above})


class Bounded:
    """Settings whose fields are checked against the bounds beside them, and against RULES, which hold between fields."""

    RULES: tuple = ()

    def __post_init__(self) -> None:
        for f in fields(self):
            value, m = getattr(self, f.name), f.metadata
            if not m:
                continue
            number = isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)
            if not number or not m["low"] <= value <= m["high"] or (m["above"] and value == m["low"]):
                raise ValueError(f"{f.name} must lie in {'(' if m['above'] else '['}{m['low']}, {m['high']}], not be {value!r}")
        for holds, text in self.RULES:
            if not holds(self):
                raise ValueError(text)


# The defaults of Sampler, Gate, Streaming and Requirements, and the bounds of their fields.
@dataclass(frozen=True)
class Sampler(Bounded):
    """Selecting an event-rich subset of scored candidates under a budget."""

    budget: int = within(32, 1)
    candidate_hz: float = within(4.0, 0, above=True)
    analysis_width: int = within(192, 16)
    min_distance_seconds: float = within(0.5, 0)
    coverage_fraction: float = within(0.25, 0, 1)
    duplicate_threshold: float = within(0.012, 0, 1)
    motion_pixel_threshold: int = within(18, 0, 255)
    frame_weight: float = within(0.45, 0)
    histogram_weight: float = within(0.20, 0)
    motion_weight: float = within(0.35, 0)
    scene_threshold: float = 0.45
    scene_boost: float = 0.25
    spike_guard: bool = True
    spike_threshold: float = within(0.35, 0, 1)
    strategy: str = "hybrid"

    RULES = (
        (lambda s: s.frame_weight + s.histogram_weight + s.motion_weight > 0, "the weights of the signals cannot all be 0"),
        (lambda s: s.strategy in STRATEGIES, f"strategy must be one of {STRATEGIES}"),
    )


@dataclass(frozen=True)
class Gate(Bounded):
    """The change gate of one stream."""

    analysis_width: int = within(192, 16)
    local_analysis_width: int = within(768, 16)
    pixel_threshold: int = within(18, 0, 255)
    min_changed_fraction: float = within(0.002, 0, 1)
    min_local_component_pixels: int = within(12, 1)
    stable_frames: int = within(1, 1)
    min_event_interval_seconds: float = within(0.5, 0)
    max_active_seconds: float = within(5.0, 0, above=True)
    crop_margin: int = within(12, 0)
    context_width: int = within(384, 16)
    detail_width: int = within(768, 16)
    jpeg_quality: int = within(80, 1, 100)
    peak_image_min_difference: float = within(0.02, 0, 1)

    RULES = ((lambda g: g.local_analysis_width >= g.analysis_width, "local_analysis_width cannot be below analysis_width"),)


@dataclass(frozen=True)
class Streaming(Bounded):
    """What a live stream keeps in state, and how often an interpretation is tried again."""

    ring_frames: int = within(8, 1)
    pending_events: int = within(16, 1)
    retries: int = within(1, 0)
    history_events: int = within(128, 1)


@dataclass(frozen=True)
class Requirements(Bounded):
    """What a comparison of systems must reach before a claim is supported."""

    min_events: int = within(180, 0)
    min_workflows: int = within(30, 0)
    min_action_failures: int = within(20, 0)
    min_reviewers: int = within(2, 0)
    min_cost_runs: int = within(3, 0)
    accuracy_noninferiority_margin: float = within(0.03, 0)
    false_confirmation_noninferiority_margin: float = within(0.01, 0)
    min_cost_reduction: float = within(0.30, 0)
    bootstrap_samples: int = within(20000, 100)
    bootstrap_seed: int = within(20260821, 0)

    RULES = ((lambda r: r.min_cost_reduction < 1, "min_cost_reduction must be under 1"),)

    @classmethod
    def over_defaults(cls, given: dict | None) -> "Requirements":
        unknown = set(given or {}) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown requirements: {sorted(unknown)}")
        return cls(**(given or {}))


@dataclass(frozen=True)
class Profile:
    """How many labels of each category a manifest needs."""

    name: str
    targets: dict[str, int] = field(default_factory=dict)
    min_cases: int = 0
    unique_transitions: bool = False


# Categories, risks and the label counts of the two profiles.
CATEGORIES = ("small_ui", "action_success", "action_failure", "popup_notification", "loading_completion", "scroll_navigation", "cursor_hover_focus", "animation_game_hud", "transient_event", "other")
RISKS = ("low", "normal", "high", "critical")
PILOT60 = Profile("pilot60", dict(zip(CATEGORIES, (10, 8, 8, 6, 6, 5, 5, 6, 6))))
CLAIM180 = Profile("claim180", dict(zip(CATEGORIES, (30, 24, 24, 18, 18, 15, 15, 18, 18))), 30, True)
COST_BASES = ("provider_invoice", "published_api_price")
