"""Operator settings. The defaults are fixed values: results depend on them."""

from __future__ import annotations

from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class RuleFilterConfig:
    interactive_categories: tuple[str, ...] = ()
    min_area: float = 1024.0
    min_clarity_score: float = 5.0
    min_mask_pixels: int = 256
    reject_border_touch: bool = True


@dataclass(frozen=True)
class GeometryConfig:
    min_mask_area_ratio: float = 0.03
    max_mask_aspect_ratio: float = 4.0
    max_border_touch_count: int = 1
    border_margin_ratio: float = 0.02
    border_margin_min_px: int = 2


@dataclass(frozen=True)
class QuotaConfig:
    target_num_candidates: int | None = None
    quota_image_count_power: float = 0.5
    quota_min_per_category: int = 1
    reuse_existing_selection_quotas: bool = False


@dataclass(frozen=True)
class DetectionConfig:
    low_confidence_threshold: float = 0.1
    max_selected_parts: int = 3
    max_masks_per_part: int = 3


@dataclass(frozen=True)
class RenderConfig:
    num_views: int = 6
    resolution: int = 512
    radius: float = 2.0
    fov_deg: float = 40.0
    view_names: tuple[str, ...] = ("front", "right", "back", "left", "top", "bottom")
    yaws_deg: tuple[float, ...] = (0.0, 90.0, 180.0, -90.0, 0.0, 0.0)
    pitches_deg: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0, 89.0, -89.0)


@dataclass(frozen=True)
class LiftConfig:
    footprint_scale: float = 1.75
    min_projected_radius_px: float = 0.0
    max_projected_radius_px: float = 12.0
    depth_tolerance_scale: float = 0.75
    depth_tolerance_min: float = 1e-3
    unlabeled_alpha: float = 0.18
    labeled_alpha: float = 1.0
    visualization_yaws_deg: tuple[float, ...] = (30.0, 150.0, 270.0)
    visualization_pitches_deg: tuple[float, ...] = (15.0, -10.0, 20.0)
    visualization_radius: float | None = None
    visualization_fov_deg: float | None = None
    visualization_resolution: int | None = None


@dataclass(frozen=True)
class FusionConfig:
    score_threshold: float = 0.3
    ambiguity_margin: float = 0.05
    duplicate_part_prune_enabled: bool = True
    duplicate_part_count_tolerance: float = 0.3
    duplicate_part_overlap_threshold: float = 0.5
    hole_fill_enabled: bool = True
    hole_fill_knn_k: int = 32
    hole_fill_min_support_neighbors: int = 2
    hole_fill_min_support_ratio: float = 0.3
    hole_fill_max_distance_factor: float = 7.0
    hole_fill_max_iterations: int = 32

    def to_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class PackagingConfig:
    colored_points_enabled: bool = True
    visualization_enabled: bool = True


@dataclass(frozen=True)
class InstructionConfig:
    instructions_per_part: int = 3
    max_instruction_words: int = 14


@dataclass(frozen=True)
class MetricConfig:
    score_threshold: float = 0.5
    support_eps: float = 1e-6


@dataclass(frozen=True)
class PseudoConfig:
    pseudo_weight: float = 0.5
    high_threshold: float = 0.8
    low_threshold: float = 0.2


@dataclass(frozen=True)
class RetryConfig:
    max_attempts: int = 5
    backoff_seconds: float = 2.0
