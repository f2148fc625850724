"""barwise: bar-panel analytics expressed as Spark DataFrame operators.

Every operator works on one DataFrame holding *all* symbols (key ``(symbol, ts)``);
per-symbol logic is a window partitioned by symbol (or by ``(symbol, block)`` in the
skew-safe segmented mode, see :mod:`barwise.operators.segments`).
"""

__all__ = ["session"]
