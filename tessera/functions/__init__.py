from .hashing import h, u  # noqa: F401
