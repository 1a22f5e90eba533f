"""Row-wise Column functions and the seeded random generator."""
from . import rng, vectors  # noqa: F401
