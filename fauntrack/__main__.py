"""python -m fauntrack --tagging-file FILE [--config FILE] [--output-dir DIR] ..."""

import sys

from fauntrack import config


def main(argv: list[str] | None = None) -> int:
    try:
        s = config.arguments(argv)
        if not s.tagging_file:
            raise ValueError("--tagging-file is needed")
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    from fauntrack.plans import run

    for name, df in run.run(SparkSession.builder.appName("fauntrack").getOrCreate(), s).items():
        print(name, df.count())
    return 0


if __name__ == "__main__":
    sys.exit(main())
