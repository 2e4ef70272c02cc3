"""One JSON document of any size: its long list is sorted and written in parts by tasks, then put between head and foot.

No list is gathered: each part is a file of one element a line, a comma before each, and the parts are streamed
behind one another into the document, less the very first comma.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.staging import fresh


def write_document(elements: DataFrame, order: list[str], path: str, head: str, foot: str) -> None:
    """Write ``head``, the JSON texts ``value`` of ``elements`` in order, and ``foot`` to the file ``path``, over what is there."""
    spark = elements.sparkSession
    folder = fresh(spark, "document")
    elements.orderBy(*order).selectExpr("concat(',', value) AS value").write.text(folder)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    to = jvm.org.apache.hadoop.fs.Path(path)
    parts = jvm.org.apache.hadoop.fs.Path(folder)
    here, there = parts.getFileSystem(conf), to.getFileSystem(conf)
    if there.exists(to) and there.getFileStatus(to).isDirectory():
        there.delete(to, True)
    out = there.create(to, True)
    try:
        out.write(bytearray(head.encode()))
        first = True
        files = [s for s in here.listStatus(parts) if s.getPath().getName().startswith("part-") and s.getLen()]
        for status in sorted(files, key=lambda s: s.getPath().getName()):
            part = here.open(status.getPath())
            try:
                if first:
                    part.seek(1)
                    first = False
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            finally:
                part.close()
        out.write(bytearray(foot.encode()))
    finally:
        out.close()
    here.delete(parts, True)
