"""python -m quadrille PATH: load a file, a folder or a project, and show what it holds. [S-15]"""

import sys

from pyspark.sql import SparkSession

from .operators import profile
from .sources.loader import EXTENSIONS, load, load_folder


def main(path: str) -> None:
    spark = SparkSession.builder.appName("quadrille").getOrCreate()
    known = path.rstrip("/").rsplit(".", 1)[-1].lower() in (*EXTENSIONS, "project")
    graph = load(spark, path) if known else load_folder(spark, path)
    profile.totals(graph).show()
    profile.instances_per_type(graph).orderBy("instances", ascending=False).show()


if __name__ == "__main__":
    main(sys.argv[1])
