"""Referential integrity of release manifests: entries, tags, dependencies, history and module trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The form of a semantic version and of a service's name, and where contracts and clients are.
SEMVER = r"^v[0-9]+\.[0-9]+\.[0-9]+\z"
SERVICE = r"^[a-z][a-z0-9]*\z"
CONTRACTS, CLIENTS = "gen/go/", "pkg/"
LICENCE = "Licensed under the Apache License, Version 2.0"
LICENCE_HEADER = r"(?s)\A// Copyright .*?\n[ \t]*// limitations under the License\.[ \t\r]*\n"


def tag_version(tag: Column) -> Column:
    """What follows the last / of a module's tag from its v on."""
    return F.regexp_extract(tag, "^.*/(v[^/]*)\\z", 1)


def tag_path(tag: Column) -> Column:
    return F.regexp_extract(tag, "^(.*)/v[^/]*\\z", 1)


def valid_tag(tag: Column, prefix: str) -> Column:
    """prefix, a name and a semantic version."""
    return tag.startswith(prefix) & (F.length(tag_path(tag)) > len(prefix)) & tag_version(tag).rlike(SEMVER)


def releases_of(manifests: DataFrame) -> DataFrame:
    """service, place, version, contract, tested_clients: manifests (service, releases) in long form."""
    rows = manifests.select("service", F.posexplode_outer("releases").alias("place", "entry"))
    empty = F.array().cast("array<string>")
    return rows.where("entry IS NOT NULL").select(
        "service", "place", F.coalesce("entry.version", F.lit("")).alias("version"), F.coalesce("entry.contract", F.lit("")).alias("contract"),
        F.coalesce("entry.tested_clients", empty).alias("tested_clients"),
    )


def clients_of(releases: DataFrame) -> DataFrame:
    return releases.select("service", "place", "version", "contract", F.posexplode("tested_clients").alias("ordinal", "client"))


def _told(rows: DataFrame, problem: str, subject: str) -> DataFrame:
    return rows.select("service", "version", F.lit(problem).alias("problem"), F.coalesce(F.col(subject), F.lit("")).alias("subject"))


def entry_violations(releases: DataFrame) -> DataFrame:
    """service, version, problem, subject of each broken rule about single entries."""
    clients, contract = clients_of(releases), F.col("contract")
    twice = clients.groupBy("service", "place", "version", "client").count().where("count > 1")
    versions = releases.groupBy("service", "version").count().where("count > 1")
    told = [
        _told(releases.where(~F.col("service").rlike(SERVICE)), "bad_service", "service"),
        _told(releases.where(~F.col("version").rlike(SEMVER)), "bad_version", "version"),
        _told(versions, "duplicate_version", "version"),
        _told(releases.where((contract == "") & (F.size("tested_clients") > 0)), "clients_without_contract", "version"),
        _told(releases.where((contract != "") & ~valid_tag(contract, CONTRACTS)), "bad_contract", "contract"),
        _told(releases.where((contract != "") & ~contract.startswith(F.concat(F.lit(CONTRACTS), "service", F.lit("/")))), "foreign_contract", "contract"),
        _told(clients.where(~valid_tag(F.col("client"), CLIENTS)), "bad_client", "client"),
        _told(twice, "duplicate_client", "client"),
    ]
    return reduce(DataFrame.unionByName, told)


def lookup_violations(manifests: DataFrame, service: str, version: str) -> DataFrame:
    """What stands against releasing a version of a service: foreign_service for a manifest of another, no_release if no
    manifest of the service has the version."""
    rows = releases_of(manifests)
    none = manifests.sparkSession.createDataFrame([(service, version)], "service string, version string").join(rows, ["service", "version"], "left_anti")
    foreign = manifests.where(F.col("service") != service).select("service", F.lit(version).alias("version"))
    return _told(foreign, "foreign_service", "service").unionByName(_told(none, "no_release", "version"))


def missing_tags(releases: DataFrame, tags: DataFrame) -> DataFrame:
    """Contracts and clients that no tag (tag) stands for."""
    named = releases.select("service", "version", F.explode(F.concat(F.array("contract"), F.col("tested_clients"))).alias("tag")).where("tag <> ''")
    return _told(named.join(tags.select("tag").distinct(), "tag", "left_anti"), "missing_tag", "tag")


def dependency_violations(releases: DataFrame, root: DataFrame, client_modules: DataFrame) -> DataFrame:
    """root (module, version) and each client of client_modules (client, module, version) must require the contract's
    version, and root one of the tested clients."""
    with_contract = releases.where("contract <> ''").withColumns({"module": tag_path(F.col("contract")), "wanted": tag_version(F.col("contract"))})
    in_root = root.select("module", F.col("version").alias("has"))
    told = [_told(with_contract.join(in_root, "module", "left").where(~F.coalesce(F.col("has") == F.col("wanted"), F.lit(False))), "root_contract", "contract")]
    clients = clients_of(releases).where("contract <> ''").withColumns({"module": tag_path(F.col("contract")), "wanted": tag_version(F.col("contract"))})
    own = client_modules.select("client", "module", F.col("version").alias("has"))
    told.append(_told(clients.join(own, ["client", "module"], "left").where(~F.coalesce(F.col("has") == F.col("wanted"), F.lit(False))), "client_contract", "client"))
    selected = selected_clients(releases, root).select("service", "place")
    told.append(_told(releases.where(F.size("tested_clients") > 0).join(selected, ["service", "place"], "left_anti"), "no_selected_client", "version"))
    return reduce(DataFrame.unionByName, told)


def selected_clients(releases: DataFrame, root: DataFrame) -> DataFrame:
    """The first tested client of each release whose version root requires."""
    clients = clients_of(releases).withColumns({"module": tag_path(F.col("client")), "wanted": tag_version(F.col("client"))})
    chosen = clients.join(root.select("module", F.col("version").alias("wanted")), ["module", "wanted"])
    return chosen.groupBy("service", "place", "version").agg(F.min_by("client", "ordinal").alias("client"))


def history_violations(current: DataFrame, released: DataFrame) -> DataFrame:
    """Against released (the releases as they were when each was tagged): none may vanish, a contract stays as it was, and
    clients are only added."""
    keys = ["service", "version"]
    old = released.select(*keys, F.col("contract").alias("was"), F.col("tested_clients").alias("had"))
    both = old.join(current, keys)
    gone = both.select(*keys, F.explode(F.array_except("had", "tested_clients")).alias("client"))
    return reduce(DataFrame.unionByName, [
        _told(old.join(current, keys, "left_anti"), "removed_release", "version"),
        _told(both.where(F.col("was") != F.col("contract")), "changed_contract", "was"),
        _told(gone, "removed_client", "client"),
    ])


def normalized(path: Column, text: Column) -> Column:
    """A file's text; of a .go file without the licence header, from its copyright line to its last line and a blank line
    after that, if the header names the licence."""
    head = F.regexp_extract(text, LICENCE_HEADER, 0)
    rest = F.regexp_replace(F.substring(text, F.length(head) + 1, F.length(text)), "\\A[ \\t\\r]*(\\n|\\z)", "")
    return F.when(path.endswith(".go") & (head != "") & head.contains(LICENCE), rest).otherwise(text)


def tree_drift(tree: DataFrame, tagged: DataFrame) -> DataFrame:
    """path, change: added, removed or changed between tagged and tree (path, text), texts compared normalized."""
    digest = F.sha2(normalized(F.col("path"), F.col("text")), 256)
    now, then = tree.select("path", digest.alias("now")), tagged.select("path", digest.alias("then"))
    change = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("then"), "changed")
    return now.join(then, "path", "full_outer").select("path", change.alias("change")).where("change IS NOT NULL")
