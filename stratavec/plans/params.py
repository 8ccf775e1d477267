"""Parameters of the indexes and of the command line, validated where they are made."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class LshParams:
    tables: int = 5
    hashes: int = 4
    width: float = 4.0
    seed: int = 1

    def __post_init__(self):
        _need(self.tables >= 1 and self.hashes >= 1, "LSH needs at least one table and one hash")
        _need(self.width > 0, "the hash width must be positive")


@dataclass(frozen=True)
class CubeParams:
    """bits: where the sign bit of a hash comes from, a linear ``hash`` or the first output of mt19937 (``twister``)."""

    projections: int = 14
    width: float = 4.0
    max_candidates: int = 10
    max_probes: int = 2
    seed: int = 1
    bits: str = "hash"

    def __post_init__(self):
        _need(self.bits in ("hash", "twister"), "the bits of a cube come from hash or twister")
        _need(1 <= self.projections <= 62, "a cube has 1 to 62 dimensions")
        _need(self.width > 0, "the hash width must be positive")
        _need(self.max_candidates >= 1 and self.max_probes >= 1, "a probe needs room for a candidate and a vertex")


@dataclass(frozen=True)
class KMeansParams:
    """empty: what a cluster without rows becomes: the row farthest from its centre, or ``keep``."""

    k: int = 4
    max_iters: int = 300
    tol: float = 1e-4
    init: str = "k-means++"
    seed: int = 1
    empty: str = "farthest"

    def __post_init__(self):
        _need(self.k >= 1, "k must be positive")
        _need(self.max_iters >= 1 and self.tol >= 0, "max_iters must be positive and tol not negative")
        _need(self.init in ("k-means++", "random"), "init is k-means++ or random")
        _need(self.empty in ("farthest", "keep"), "empty is farthest or keep")


@dataclass(frozen=True)
class IvfParams:
    """clusters of 0 or less: chosen by silhouette."""

    clusters: int = 50
    nprobe: int = 5
    seed: int = 1
    max_iters: int = 100
    tol: float = 1e-4
    empty: str = "farthest"

    def __post_init__(self):
        _need(self.nprobe >= 1, "nprobe must be positive")


@dataclass(frozen=True)
class PqParams:
    parts: int = 16
    bits: int = 8
    seed: int = 1337
    max_iters: int = 100
    tol: float = 1e-4
    sample: int = 20_000
    empty: str = "farthest"

    def __post_init__(self):
        _need(self.parts >= 1, "a product quantizer has at least one part")
        _need(1 <= self.bits <= 16, "codes have 1 to 16 bits")
        _need(self.sample >= 1, "the training sample must not be empty")

    @property
    def codes(self) -> int:
        return 1 << self.bits


#: Default radii by dataset kind, for callers that give none.
RADIUS = {"sift": 2.0, "mnist": 2000.0, "mnist-normalised": 2.0}


@dataclass(frozen=True)
class SearchParams:
    """What a search run does: files, method, neighbours, radius and the indexes' parameters."""

    data: str = "data/input.dat"
    queries: str = "data/query.dat"
    output: str = "results.txt"
    kind: str = "mnist"
    method: str | None = None
    n: int = 1
    radius: float | None = None
    do_range: bool = True
    graph: bool = False
    max_data: int | None = 10_000
    max_queries: int | None = 100
    lsh: LshParams = field(default_factory=LshParams)
    cube: CubeParams = field(default_factory=CubeParams)
    ivf: IvfParams = field(default_factory=IvfParams)
    pq: PqParams = field(default_factory=PqParams)

    def __post_init__(self):
        _need(self.n >= 1, "N must be positive")
        _need(self.method in (None, "lsh", "hypercube", "ivfflat", "ivfpq"), "unknown method")

    def echo(self) -> list[tuple[str, str]]:
        """(name, value) of every parameter, those of the indexes as index.name."""
        out = []
        for name, value in asdict(self).items():
            out += [(f"{name}.{k}", str(v)) for k, v in value.items()] if isinstance(value, dict) else [(name, str(value))]
        return out

    @property
    def effective_radius(self) -> float:
        return RADIUS.get(self.kind, 2000.0) if self.radius is None else self.radius
