"""Trees of files, listed level by level: what is excluded is never entered, and links aren't followed.

The folders of a level are listed at once by a pool of threads, each a call to the store that holds them; a
folder costs one call, an excluded one none, whatever lies in it. Names go to Spark's reader as paths, which
opens the files in tasks; like its own index of files, the list of names is the driver's. That reader passes over
names that begin with a dot or an underscore, where keys often lie: those files are streamed to the shared folder
under other names first. Empty files have a row as well.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import fresh

#: Folders that are listed at once.
THREADS = 16
#: Signs that a path's pattern gives a meaning.
GLOB = "\\{}[]*?"


def _fits(name: str, wanted: str) -> bool:
    """``*suffix``, else ``prefix*``, else equal."""
    if wanted.startswith("*"):
        return name.endswith(wanted[1:])
    return name.startswith(wanted[:-1]) if wanted.endswith("*") else name == wanted


class Store:
    """The store of a root, as the session's Hadoop settings name it."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        path = self.jvm.org.apache.hadoop.fs.Path(root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.root = self.fs.makeQualified(path)
        self.local = self.fs.getUri().getScheme() == "file"

    def is_link(self, status) -> bool:
        if self.local:  # there a status is that of what the link leads to
            return self.jvm.java.nio.file.Files.isSymbolicLink(self.jvm.java.io.File(status.getPath().toUri().getPath()).toPath())
        return status.isSymlink()

    def names(self, folder) -> tuple[list, list]:
        """Paths and sizes of a folder's files and folders, links left out; of a file its own. A folder that can't be read has none."""
        from py4j.protocol import Py4JJavaError

        files, folders = [], []
        try:
            found = self.fs.listStatusIterator(folder)
            while found.hasNext():
                status = found.next()
                if not self.is_link(status):
                    (folders if status.isDirectory() else files).append((status.getPath(), status.getLen()))
        except Py4JJavaError as e:
            if "FileNotFound" not in str(e.java_exception.getClass()) and "AccessControl" not in str(e.java_exception.getClass()) and "AccessDenied" not in str(e.java_exception):
                raise
        return files, folders


def list_tree(spark: SparkSession, root: str, exclude_dirs: Sequence[str] = (), exclude_files: Sequence[str] = (), threads: int = THREADS) -> list[tuple[str, int]]:
    """The paths, below ``root``, and sizes of the files of a tree. Only the tree's own folders count as excluded, not those above it."""
    store = Store(spark, root)
    prefix = len(store.root.toString().rstrip("/")) + 1
    out: list[tuple[str, int]] = []
    level = [store.root]
    with ThreadPoolExecutor(threads) as pool:
        while level:
            found = list(pool.map(store.names, level))
            out += [(p.toString()[prefix:], n) for files, _ in found for p, n in files if not any(_fits(p.getName(), x) for x in exclude_files)]
            level = [p for _, folders in found for p, _ in folders if p.getName() not in exclude_dirs]
    return sorted(out)


def _escaped(path: str) -> str:
    return "".join("\\" + c if c in GLOB else c for c in path)


def _under_other_names(spark: SparkSession, store: Store, base: str, names: list[str]) -> DataFrame:
    """path and text of files by copies in the shared folder."""
    folder = fresh(spark, "hidden")
    to = store.jvm.org.apache.hadoop.fs.Path(folder)
    other, conf = to.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jsc.hadoopConfiguration()
    copy, path = store.jvm.org.apache.hadoop.fs.FileUtil.copy, store.jvm.org.apache.hadoop.fs.Path
    with ThreadPoolExecutor(THREADS) as pool:
        list(pool.map(lambda k: copy(store.fs, path(f"{base}/{names[k]}"), other, path(f"{folder}/f{k}"), False, conf), range(len(names))))
    texts = spark.read.text(folder, wholetext=True).select(F.regexp_extract("_metadata.file_name", "([0-9]+)$", 1).cast("int").alias("k"), F.col("value").alias("text"))
    return spark.createDataFrame(list(enumerate(names)), "k int, path string").join(texts, "k").select("path", "text")


def read_tree(spark: SparkSession, root: str, exclude_dirs: Sequence[str] = (), exclude_files: Sequence[str] = ()) -> DataFrame:
    """path (below ``root``) and text of the files of a tree, on any store that Spark reads."""
    found = list_tree(spark, root, exclude_dirs, exclude_files)
    store = Store(spark, root)
    base = store.root.toString().rstrip("/")
    hidden = [n for n, size in found if size and n.rpartition("/")[2].startswith((".", "_"))]
    plain = [n for n, size in found if size and not n.rpartition("/")[2].startswith((".", "_"))]
    out = spark.createDataFrame([(n, "") for n, size in found if not size], "path string, text string")
    if hidden:
        out = out.unionByName(_under_other_names(spark, store, base, hidden))
    if plain:
        texts = spark.read.text([_escaped(f"{base}/{n}") for n in plain], wholetext=True)
        # a file's name comes as a link, with escapes, and some stores' with an empty host: path names begin at the same place
        scheme = base.partition(":")[0]
        name = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), f"^{scheme}:///", f"{scheme}:/")
        out = out.unionByName(texts.select(F.substring(name, len(base) + 2, 1 << 30).alias("path"), F.col("value").alias("text")))
    return out
