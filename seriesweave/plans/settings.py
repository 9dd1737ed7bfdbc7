"""Session settings that the operators run best with; the library itself changes none."""

from __future__ import annotations

#: To pass to ``SparkSession.builder.config(map=...)`` or ``spark.conf.set``.
RECOMMENDED = {
    # HotSpot does not compile methods of more than 8,000 bytes of byte code, so a longer one that Spark generates
    # for a whole stage is interpreted row by row; with this limit Spark runs its operators one by one instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}
