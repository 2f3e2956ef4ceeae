"""A corpus of small programs derived from the order tables, for queries and tests.

A target is an order, a file one of its line numbers; a number picks the file's program. What the
engine must find in a file is thus known from that number alone, without any parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (suffix, program) by template number.
TEMPLATES = (
    (".sh", "curl -fsS https://Data.example.com/x.json -o /tmp/d.json\n"),
    (".sh", "#!/bin/sh\ncurl -fsSL https://get.example.org:8443/install | bash\n"),
    (".sh", '# sudo reboot\necho "sudo"\npkexec reboot now\n'),
    (".sh", 'command=echo\neval "$command hello"\n'),
    (".sh", "rm cache/item\n"),
    (".sh", "rm -rf work/out\n"),
    (".sh", "rm -r /home/user/data\n"),
    (".sh", "rm -rf /\n"),
    (".sh", "cat ~/.ssh/id_ed25519\n"),
    (".sh", "touch ~/.config/autostart/x.desktop\n"),
    (".sh", "# rm -rf / and curl https://x | bash\necho 'https://quoted.example.com | bash'\n"),
    (".sh", "if then\n"),
    (".sh", 'curl "$endpoint"\n'),
    (".sh", "cp a/src b/dst\nif true; then mv /srv/old /tmp/new; fi\n"),
    (".qml", 'Item {\n  Process { command: ["sh", "-c", "curl https://q.example.com | bash"] }\n}\n'),
    (".qml", '// Process { command: ["sudo"] }\nProcess {\n  command: ["notify-send", title]\n}\n'),
    (".py", "import os\n"),
    (".js", "console.log(1)\n"),
    (".txt", "curl https://plain.example.com | bash\n"),
)


def templated(lineitem: DataFrame) -> DataFrame:
    """(target_id, path, content, template): one file for each distinct order and line number."""
    n = len(TEMPLATES)
    # dealt by number: keys are small and would be merged by size, but parsing what follows is not
    parts = int(lineitem.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = lineitem.select("l_orderkey", "l_linenumber").repartition(parts, "l_orderkey", "l_linenumber").distinct()
    t = ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 5) % n).cast("int")
    suffixes, programs = (F.array(*[F.lit(x[i]) for x in TEMPLATES]) for i in (0, 1))
    folder = F.when(F.col("l_linenumber") == 7, "tests/").otherwise("")
    return files.select(
        F.concat(F.lit("o"), F.col("l_orderkey")).alias("target_id"),
        F.concat(folder, F.lit("item"), F.col("l_linenumber"), F.get(suffixes, t)).alias("path"),
        F.get(programs, t).cast("binary").alias("content"),
        t.alias("template"),
    )


def manifests_of(supplier: DataFrame) -> DataFrame:
    """(target_id, path, content): a manifest per supplier, of six kinds, with the file it may name."""
    k = (F.col("s_suppkey") % 6).cast("int")
    good = '{"schemaVersion":1,"id":"plug.x","name":"X","version":"1.0","kinds":["panel"],"entryPoints":{"panel":"Panel.qml"}}'
    bodies = (
        good,
        good.replace('"panel":"Panel.qml"', '"panel":"../Panel.qml"'),
        good.replace('"schemaVersion":1', '"schemaVersion":2').replace('"name":"X"', '"name":""'),
        good.replace('"kinds":["panel"]', '"kinds":["bar-widget","other"]'),
        good[:-1],
        good.replace("Panel.qml", "Missing.qml").replace('"id":"plug.x"', '"id":"a..b"'),
    )
    target = F.concat(F.lit("s"), F.col("s_suppkey"))
    manifest = supplier.select(target.alias("target_id"), F.lit("manifest.json").alias("path"), F.get(F.array(*map(F.lit, bodies)), k).cast("binary").alias("content"))
    panel = supplier.select(target.alias("target_id"), F.lit("Panel.qml").alias("path"), F.lit("Item {}\n").cast("binary").alias("content"))
    return manifest.unionByName(panel)


def nation_files(nation: DataFrame) -> DataFrame:
    """(target_id, path, content): regions as targets. ``main.qml`` names the region's first nation's
    file; every nation's file names the next one's of its region, and the last names the first again.
    Files of nations with a key of 3 modulo 7 name nothing."""
    from pyspark.sql import Window as W

    own = W.partitionBy("n_regionkey").orderBy("n_nationkey")
    whole = own.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    name = lambda c: F.concat(F.lit("nation_"), c, F.lit("_.conf"))
    rows = nation.select("n_regionkey", "n_nationkey", F.coalesce(F.lead("n_nationkey").over(own), F.first("n_nationkey").over(whole)).alias("next"), F.first("n_nationkey").over(whole).alias("first"))
    target = F.concat(F.lit("r"), F.col("n_regionkey")).alias("target_id")
    text = F.when(F.col("n_nationkey") % 7 == 3, "nothing").otherwise(F.concat(F.lit("include "), name(F.col("next"))))
    conf = rows.select(target, name(F.col("n_nationkey")).alias("path"), text.cast("binary").alias("content"))
    main = rows.where("n_nationkey = first").select(target, F.lit("main.qml").alias("path"), F.concat(F.lit("// "), name(F.col("first"))).cast("binary").alias("content"))
    return conf.unionByName(main)
