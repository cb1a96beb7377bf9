"""python -m fathomline features|dataset|replay|check-bundle|check-settings ...: the engine from the command line."""

from __future__ import annotations

import argparse
import sys

from fathomline import session


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="fathomline", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("features", help="feature rows of all files below a folder, as Parquet or (by suffix) CSV")
    p.add_argument("folder"), p.add_argument("output"), p.add_argument("--most-bytes", type=int, default=100 * 1024 * 1024)
    p = commands.add_parser("dataset", help="feature rows of the class folders with their split")
    p.add_argument("folder"), p.add_argument("output")
    p = commands.add_parser("replay", help="scores and responses for recorded events")
    p.add_argument("events"), p.add_argument("output"), p.add_argument("--window-seconds", type=float), p.add_argument("--settings", help="filters and windows by a settings file")
    p = commands.add_parser("check-settings", help="whether a settings file can be used")
    p.add_argument("settings")
    p = commands.add_parser("check-bundle", help="whether a saved bundle can be used")
    p.add_argument("bundle")
    a = parser.parse_args(arguments)
    if a.command == "check-settings":
        from fathomline.sources import settings

        try:
            settings.load(a.settings)
        except settings.ConfigurationError as e:
            print(e)
            return 1
        print("ok")
        return 0
    if a.command == "check-bundle":
        from fathomline.operators.bundle import Bundle

        found = Bundle.load(a.bundle).problems()
        print("\n".join(found) or "ok")
        return int(bool(found))
    from pyspark.sql import functions as F

    from fathomline.operators import events, extraction, profiles, sampling
    from fathomline.sources import files

    spark = session.local()
    if a.command == "features":
        rows = extraction.features(files.scan(spark, a.folder, a.most_bytes), "path")
        files.write_csv(rows, a.output) if a.output.endswith(".csv") else rows.write.mode("overwrite").parquet(a.output)
    elif a.command == "dataset":
        scanned = files.scan_classes(spark, a.folder)
        rows = extraction.features(scanned, "path", carried=tuple(c for c in scanned.columns if c not in ("path", "content", "size_bytes")))
        sampling.grouped_split(rows).write.mode("overwrite").partitionBy("split").parquet(a.output)
    else:
        from fathomline.sources import settings

        known = settings.load(a.settings) if a.settings else None
        window = int(a.window_seconds * 1e6) if a.window_seconds else known.profile_us if known else 30_000_000
        replay = events.prefilter(files.read_events(spark, a.events), known.filters if known else events.FilterConfig()).filter("filter_decision <> 'drop'")
        replay = replay.withColumns({"predicted_class": F.lit(None).cast("string"), "probability": F.lit(None).cast("double")})
        scored = profiles.respond(profiles.with_score(profiles.profiles(replay, window)))
        scored.write.mode("overwrite").parquet(a.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
