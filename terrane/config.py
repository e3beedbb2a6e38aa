"""Parameters of the mapping operators with their defaults, and presets for common sensors."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Cropping:
    kind: str = "MaxRadius"
    min_z: float = -10.0
    max_z: float = 10.0
    min_radius: float = 0.0
    max_radius: float = 20.0

    def arguments(self) -> dict[str, float]:
        """Keyword arguments for ``crop.crop_predicate`` of this kind."""
        return {
            "MaxRadius": {"radius": self.max_radius},
            "MinRadius": {"radius": self.min_radius},
            "MinMaxRadius": {"low": self.min_radius, "high": self.max_radius},
            "Cylinder": {"radius": self.max_radius, "low": self.min_z, "high": self.max_z},
        }.get(self.kind, {})


@dataclass(frozen=True)
class ScanProcessing:
    downsampling_ratio: float = 1.0
    voxel_size: float = 0.03
    accumulated_scans: int = 1
    cropping: Cropping = Cropping()


@dataclass(frozen=True)
class Registration:
    kind: str = "PointToPlane"
    max_iterations: int = 50
    max_distance: float = 0.2
    knn: int = 5
    knn_radius: float = 10.0


@dataclass(frozen=True)
class Carving:
    voxel_size: float = 0.1
    max_ray: float = 20.0
    truncation: float = 0.1
    every: int = 10
    min_dot: float = 0.5
    dense_radius: float = 0.1


@dataclass(frozen=True)
class Submaps:
    radius: float = 20.0
    min_scans: int = 5
    feature_period_s: float = 5.0
    min_overlap: float = 0.4
    overlap_scans: int = 3


@dataclass(frozen=True)
class Consistency:
    max_roll_deg: float = 90.0
    max_pitch_deg: float = 90.0
    max_yaw_deg: float = 90.0
    max_x: float = 10.0
    max_y: float = 10.0
    max_z: float = 15.0


@dataclass(frozen=True)
class PlaceRecognition:
    normal_radius: float = 1.0
    feature_voxel: float = 0.5
    feature_radius: float = 2.5
    feature_knn: int = 100
    normal_knn: int = 10
    ransac_hypotheses: int = 1_000_000
    ransac_probability: float = 0.99
    ransac_distance: float = 0.75
    ransac_edge: float = 0.5
    min_matches: int = 25
    icp_distance: float = 0.3
    min_fitness: float = 0.7
    min_gap: int = 2
    search_radius: float | None = 20.0
    consistency: Consistency = Consistency()


@dataclass(frozen=True)
class GlobalOptimisation:
    max_distance: float = 10.0
    loop_preference: float = 2.0
    prune: float = 0.2
    reference_node: int = 0


@dataclass(frozen=True)
class MotionCompensation:
    enabled: bool = False
    clockwise: bool = True
    scan_seconds: float = 0.1
    poses_for_velocity: int = 3


@dataclass(frozen=True)
class Mapping:
    odometry: ScanProcessing = ScanProcessing()
    odometry_registration: Registration = Registration()
    mapper: ScanProcessing = ScanProcessing()
    mapper_registration: Registration = Registration()
    min_fitness: float = 0.7
    min_movement: float = 0.0
    map_voxel: float = 0.03
    carving: Carving = Carving()
    submaps: Submaps = Submaps()
    place_recognition: PlaceRecognition = PlaceRecognition()
    optimisation: GlobalOptimisation = GlobalOptimisation()
    motion: MotionCompensation = MotionCompensation()
    extra: dict = field(default_factory=dict)

    @property
    def search_radius(self) -> float:
        """Falls back to the size of a submap where none is set."""
        return self.place_recognition.search_radius or self.submaps.radius


#: Factors of the map's voxel size, and the scans that a session starts with and drops.
FALLBACK_VOXEL = 0.04
OVERLAP_VOXEL_FACTOR = 20.0
CONSTRAINT_DISTANCE_FACTOR = 1.5
OCCUPANCY_VOXEL_FACTOR = 2.5
SKIPPED_SCANS = 5


_WIDE = Consistency(30.0, 30.0, 30.0, 80.0, 80.0, 40.0)


def _sensor(odometry: tuple, mapper: tuple, map_voxel: float, truncation: float = 0.1, every: int = 10, fitness: float = 0.7, gap: int = 2, size: float = 20.0, distances: tuple[float, float] = (1.0, 0.8), low: float = 2.0, deskew: bool = False) -> Mapping:
    """(voxel size, sampling ratio, outer radius) of the scans for odometry and for the map, and what else a sensor changes."""
    scans = [ScanProcessing(ratio, voxel, 1, Cropping("MinMaxRadius", min_radius=low, max_radius=high)) for voxel, ratio, high in (odometry, mapper)]
    icp = [Registration("Generalized", max_distance=d) for d in distances]
    place = PlaceRecognition(min_matches=40, min_fitness=fitness, min_gap=gap, consistency=_WIDE)
    return Mapping(odometry=scans[0], odometry_registration=icp[0], mapper=scans[1], mapper_registration=icp[1], map_voxel=map_voxel, carving=Carving(truncation=truncation, every=every), submaps=Submaps(radius=size, overlap_scans=10), place_recognition=place, motion=MotionCompensation(enabled=deskew))


#: Fixed values of the sensor presets.
PRESETS = {
    "default": Mapping(),
    "spinning_16": _sensor((0.05, 1.0, 30.0), (0.08, 0.25, 30.0), 0.1),
    "spinning_64": _sensor((0.2, 0.3, 30.0), (0.3, 0.25, 30.0), 0.3, truncation=0.5, every=20, fitness=0.8, gap=5),
    "spinning_128": _sensor((0.15, 0.5, 30.0), (0.2, 0.5, 30.0), 0.25, truncation=0.45),
    "short_range_64": _sensor((0.05, 0.9, 30.0), (0.1, 0.4, 25.0), 0.1),
    "spinning_16_deskewed": _sensor((0.05, 1.0, 40.0), (0.08, 0.25, 40.0), 0.1, deskew=True),
    "depth_camera": _sensor((0.02, 0.6, 2.0), (0.03, 0.6, 2.0), 0.03, truncation=0.45, every=1_000_000_000, size=3.0, distances=(0.2, 0.1), low=0.0),
}
