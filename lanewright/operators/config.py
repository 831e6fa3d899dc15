"""Settings of the scene and road operators."""

from __future__ import annotations

from dataclasses import dataclass

PROFILES = ("py", "rs", "legacy", "explore")


@dataclass(frozen=True)
class SceneConfig:
    """How scenes are read. ``profile`` picks one of several generations of semantics that disagree:

    py: an item inside a symbol has the symbol's transform only, names are inherited, flags come from a child element.
    rs: items compose with their symbol, names are their own, flags come from the item, ellipses and barriers count.
    legacy and explore: as py, but for closing rules, line style and what counts as roadway.

    ``vehicle_probability`` and ``compute_transforms`` are carried for completeness; nothing reads them.
    """

    profile: str = "py"
    bezier_samples: int = 10
    closure_threshold: float = 0.25
    text_distance: float = 5.0
    vehicle_probability: float = 0.7
    compute_transforms: bool = True

    def __post_init__(self) -> None:
        if self.profile not in PROFILES:
            raise ValueError(f"profile is one of {', '.join(PROFILES)}")


@dataclass(frozen=True)
class CenterlineConfig:
    """How centerlines are extracted; ``for_profile`` gives each generation's values."""

    min_width: float = 5.0
    max_width: float = 15.0
    resample_step: float = 1.0
    cluster_threshold: int = 10
    parallel_degrees: float = 15.0
    edge_reach: float = 2.0
    link_distance: float = 10.0
    link_degrees: float = 15.0
    strict_link: bool = False
    min_length: float = 5.0
    max_mean_step: float = 1.0
    split_two: float = 22.0
    split_three: float = 32.0
    smooth: int = 3
    by_longest_edge: bool = False
    valid_neighbour_only: bool = False
    cone: bool = True
    millis: bool = False
    fixed_back: bool = False
    split: bool = True

    @classmethod
    def for_profile(cls, profile: str, **changes) -> CenterlineConfig:
        base = {
            "py": {},
            "legacy": {},
            "rs": {"link_distance": 8.0, "strict_link": True, "max_mean_step": 8.0, "by_longest_edge": True, "valid_neighbour_only": True, "cone": False, "millis": True, "fixed_back": True, "split": False, "smooth": 0},
            "explore": {"link_distance": 8.0, "by_longest_edge": True, "cone": False, "fixed_back": True, "smooth": 0},
        }[profile]
        return cls(**base | changes)
