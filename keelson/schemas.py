"""Column layouts of the tables that a store keeps."""

from pyspark.sql import types as T

_L, _S, _I = T.LongType(), T.StringType(), T.IntegerType()


def _of(**cols):
    return T.StructType([T.StructField(n, t, True) for n, t in cols.items()])


#: A row without v deletes its key.
SEGMENT = _of(k=_S, v=_S, seq=_L)
MANIFEST = _of(version=_L, level=_I, pos=_I, sst_id=_L, first_key=_S, last_key=_S, n=_L, bytes=_L)
