"""Schemas of the golden tests."""

from stratapoint.schema import Dimension, Schema


def dims(*specs):
    return [Dimension(n, 0, k, s, o) for n, k, s, o in ((*x, 1.0, 0.0)[:2] + tuple((*x[2:], *((1.0, 0.0)[len(x) - 2 :]))) for x in specs)]


XYZI = (("X", "int32_t", 0.01), ("Y", "int32_t", 0.01), ("Z", "int32_t", 0.01), ("Intensity", "uint16_t"))
S1 = Schema.of(dims(*XYZI), 1)
S3 = Schema.of(dims(*XYZI), 3, 0, "dimensional")
S4 = Schema.of(dims(("I1", "uint16_t"), *XYZI[:3], ("I2", "uint16_t")), 4)
MIXED = (("x", "int8_t", 0.01), ("y", "int8_t", 0.01), ("i2", "int16_t", 0.01), ("i4", "int32_t", 0.01), ("i8", "int64_t", 0.01), ("f4", "float", 0.01), ("f8", "double", 0.01))
S10 = Schema.of(dims(*MIXED), 10)
S11 = Schema.of(dims(*MIXED), 11, 0, "dimensional")
S20 = Schema.of(dims(("X", "int32_t"), ("Y", "int32_t"), ("Z", "int32_t")), 20, 0, "dimensional")
