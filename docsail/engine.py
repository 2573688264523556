"""The engine's surface: projects and indexes, writes to the log, builds, queries and fetches."""

from __future__ import annotations

import json
import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docsail.errors import bad_request, conflict, not_found
from docsail.operators.merge import SCHEMA, current, hidden, merge
from docsail.operators.search import check_size, fetch, search
from docsail.plans.requests import read_query
from docsail.schema import Mapping
from docsail.session import prepare
from docsail.sources.documents import log_of_bulk, log_of_deletes, log_of_documents, new_write, read_bulk
from docsail.sources.files import Lock, claim, delete, exists, names, read_text, write_text
from docsail.streaming import build

CLASSES = ("STANDARD", "INFREQUENT_ACCESS")
_WAIT = 30.0


def pruned(doc: dict, fields: list[str] | None, mapping: Mapping, vectors: bool) -> dict:
    """A document with the asked leaves only, its id always, and vectors if asked; objects that lose all members go."""

    def walk(value: dict, prefix: str) -> dict:
        out = {}
        for k, v in value.items():
            path = prefix + k
            declared = mapping.leaf(path)
            if declared is not None and declared.kind == "vector":
                if vectors:
                    out[k] = v
            elif isinstance(v, dict):
                if (inner := walk(v, path + ".")) or (fields is None and not v):
                    out[k] = inner
            elif fields is None or path in fields or path == "id":
                out[k] = v
        return out

    return walk(doc, "")


class Engine:
    """All state lives under ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = prepare(spark), root.rstrip("/")
        self._last = 0

    def _seq(self) -> int:
        self._last = max(self._last + 1, time.time_ns())
        return self._last

    # projects

    def _project_file(self, project: str) -> str:
        return f"{self.root}/catalog/{project}/project.json"

    def create_project(self, name: str) -> dict:
        if not isinstance(name, str) or not re.fullmatch(r"[a-zA-Z0-9_-]{3,45}", name):
            raise bad_request("a project's name has 3 to 45 letters, digits, _ or -")
        entry = {"name": name, "status": "ACTIVE", "createdAt": time.time_ns() // 1_000_000}
        if not claim(self.spark, self._project_file(name), json.dumps(entry)):
            raise conflict(f"project {name} exists")
        return entry

    def describe_project(self, project: str) -> dict:
        said = read_text(self.spark, self._project_file(project)) if isinstance(project, str) and project else None
        if not said:
            raise not_found(f"no project {project}")
        return json.loads(said)

    def list_projects(self) -> list[dict]:
        return [self.describe_project(p) for p in names(self.spark, f"{self.root}/catalog") if read_text(self.spark, self._project_file(p))]

    def update_project(self, project: str, **changes) -> dict:
        self.describe_project(project)
        with Lock(self.spark, f"{self.root}/catalog/{project}/lock.json", _WAIT):
            entry = self.describe_project(project) | {k: v for k, v in changes.items() if k not in ("name", "createdAt")}
            write_text(self.spark, self._project_file(project), json.dumps(entry))
        return entry

    def delete_project(self, project: str) -> None:
        self.describe_project(project)
        if self.list_indexes(project):
            raise conflict(f"project {project} still has indexes")
        delete(self.spark, f"{self.root}/catalog/{project}")

    # indexes

    def _index_file(self, project: str, index: str) -> str:
        return f"{self.root}/catalog/{project}/indexes/{index}.json"

    def _folder(self, project: str, index: str) -> str:
        return f"{self.root}/data/{project}/{index}"

    def create_index(self, project: str, index: str, mappings: dict | None = None, index_class: str = "STANDARD", source: tuple[str, str] | None = None) -> dict:
        """A new index, or with ``source`` (project, index) a clone that shares its snapshot; a clone's mapping may add fields."""
        self.describe_project(project)
        if not isinstance(index, str) or not re.fullmatch(r"[a-zA-Z0-9_-]{3,52}", index):
            raise bad_request("an index's name has 3 to 52 letters, digits, _ or -")
        if index_class not in CLASSES:
            raise bad_request(f"the class must be one of {', '.join(CLASSES)}")
        mapping = Mapping.parse(mappings) if source is None else self._mapping(*source)
        if source is not None and mappings:
            mapping = mapping.extended(mappings)
        entry = {"name": index, "status": "CREATING", "class": index_class, "mappings": mapping.to_json(), "source": source}
        if not claim(self.spark, self._index_file(project, index), json.dumps(entry)):
            raise conflict(f"index {index} exists")
        try:
            if source is not None:
                self._share(source, (project, index))
        except BaseException:
            delete(self.spark, self._index_file(project, index))
            raise
        entry["status"] = "ACTIVE"
        write_text(self.spark, self._index_file(project, index), json.dumps(entry))
        return entry

    def _share(self, source: tuple[str, str], goal: tuple[str, str]) -> None:
        self.build(*source)
        folder = f"{self._folder(*source)}/collection"
        said = build.manifest(self.spark, folder)
        if not said:
            return
        if "/" not in said["snapshot"]:
            pinned = json.loads(read_text(self.spark, f"{folder}/pinned.json") or "[]")
            write_text(self.spark, f"{folder}/pinned.json", json.dumps(sorted({*pinned, said["snapshot"]})))
            said["snapshot"] = f"{folder}/{said['snapshot']}"
        said |= {"merged": [], "filters": [], "streams": {}}
        write_text(self.spark, f"{self._folder(*goal)}/collection/manifest.json", json.dumps(said))
        for name in names(self.spark, f"{self._folder(*source)}/filters"):
            write_text(self.spark, f"{self._folder(*goal)}/filters/{name}", read_text(self.spark, f"{self._folder(*source)}/filters/{name}"))

    def describe_index(self, project: str, index: str) -> dict:
        said = read_text(self.spark, self._index_file(project, index)) if isinstance(index, str) and index else None
        if not said:
            raise not_found(f"no index {index}")
        return json.loads(said) | {"numDocs": build.manifest(self.spark, f"{self._folder(project, index)}/collection").get("rows", 0)}

    def list_indexes(self, project: str) -> list[dict]:
        return [self.describe_index(project, n[:-5]) for n in names(self.spark, f"{self.root}/catalog/{project}/indexes") if n.endswith(".json")]

    def update_index(self, project: str, index: str, mappings: dict) -> dict:
        self.describe_index(project, index)
        with Lock(self.spark, f"{self._folder(project, index)}/entry/lock.json", _WAIT):
            entry = self.describe_index(project, index)
            entry["mappings"] = self._mapping(project, index).extended(mappings).to_json()
            write_text(self.spark, self._index_file(project, index), json.dumps(entry))
        return entry

    def delete_index(self, project: str, index: str) -> None:
        entry = self.describe_index(project, index)
        if exists(self.spark, f"{self._folder(project, index)}/collection/pinned.json"):
            raise conflict(f"clones share the data of {index}")
        write_text(self.spark, self._index_file(project, index), json.dumps(entry | {"status": "DELETING"}))
        delete(self.spark, self._folder(project, index))
        delete(self.spark, self._index_file(project, index))

    def _mapping(self, project: str, index: str) -> Mapping:
        return Mapping.parse(self.describe_index(project, index)["mappings"])

    # writes

    def _append(self, project: str, index: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self._folder(project, index)}/wal")

    def upsert(self, project: str, index: str, documents: list[dict]) -> list[str]:
        """Appends documents to the log, all or none; returns their ids."""
        rows, ids = log_of_documents(self.spark, documents, self._mapping(project, index), self._seq())
        self._append(project, index, rows.coalesce(1))
        return ids

    def bulk_path(self, project: str, index: str) -> str:
        """A place to put a file of documents for bulk_upsert."""
        self.describe_index(project, index)
        return f"{self._folder(project, index)}/uploads/{new_write()}"

    def bulk_upsert(self, project: str, index: str, path: str, kind: str = "json") -> None:
        mapping = self._mapping(project, index)
        self._append(project, index, log_of_bulk(read_bulk(self.spark, path, kind), mapping, self._seq(), new_write()))

    def delete(self, project: str, index: str, ids: list[str] | None = None, filter: dict | None = None) -> None:
        if (ids is None) == (filter is None):
            raise bad_request("a delete needs either ids or a filter")
        mapping, seq = self._mapping(project, index), self._seq()
        if ids is not None:
            self._append(project, index, log_of_deletes(self.spark, ids, seq).coalesce(1))
            return
        hidden(current(self.spark.createDataFrame([], SCHEMA), mapping, store=True), mapping, [(filter, seq)])  # compiles, or says why not
        write_text(self.spark, f"{self._folder(project, index)}/filters/{seq}.json", json.dumps(filter))

    def _filters(self, project: str, index: str) -> dict[str, tuple[dict, int]]:
        folder = f"{self._folder(project, index)}/filters"
        return {n: (json.loads(said), int(n[:-5])) for n in names(self.spark, folder) if n.endswith(".json") and (said := read_text(self.spark, f"{folder}/{n}"))}

    # builds

    def build(self, project: str, index: str) -> int:
        """Merges the log and the deletes by filter into a new snapshot; returns the live rows.

        Log files and filters go one build after the one that merged them, so that a write under way meets its filter.
        """
        folder, mapping = self._folder(project, index), self._mapping(project, index)
        with Lock(self.spark, f"{folder}/collection/lock.json"):
            files, filters, said = names(self.spark, f"{folder}/wal"), self._filters(project, index), build.manifest(self.spark, f"{folder}/collection")
            new = set(files) - set(said.get("merged", [])) or set(filters) - set(said.get("filters", []))
            if new or (said and said.get("mapping") != mapping.to_json()):
                log = self.spark.read.schema(SCHEMA).parquet(*[f"{folder}/wal/{n}" for n in files]) if files else self.spark.createDataFrame([], SCHEMA)
                rows = merge(build.latest(self.spark, f"{folder}/collection"), log)
                self._cleared(folder, build.commit(self.spark, f"{folder}/collection", rows, mapping, files, filters))
            return build.manifest(self.spark, f"{folder}/collection").get("rows", 0)

    def _cleared(self, folder: str, before: dict) -> None:
        """Removes what the manifest before the last commit had merged."""
        for kind, place in (("merged", "wal"), ("filters", "filters")):
            for name in before.get(kind, []):
                delete(self.spark, f"{folder}/{place}/{name}")

    def stream(self, project: str, index: str, trigger: dict | None = None) -> StreamingQuery:
        """Builds continuously; each batch takes the same lock as build()."""
        folder = self._folder(project, index)
        return build.start(
            self.spark, f"{folder}/wal", f"{folder}/collection", f"{folder}/checkpoint", trigger=trigger, mapping=self._mapping(project, index),
            filters=lambda: self._filters(project, index), cleared=lambda before: self._cleared(folder, before),
        )

    # reads

    def collection(self, project: str, index: str, consistent: bool = False) -> tuple[DataFrame, Mapping]:
        """The live rows, typed: of the last snapshot, or with what the log has beyond it merged over it."""
        folder, mapping = self._folder(project, index), self._mapping(project, index)
        said, rows = build.manifest(self.spark, f"{folder}/collection"), build.latest(self.spark, f"{folder}/collection")
        filters = [f for name, f in self._filters(project, index).items() if name not in said.get("filters", [])]
        newer = sorted(set(names(self.spark, f"{folder}/wal")) - set(said.get("merged", []))) if consistent else []
        if newer:
            filters = list(self._filters(project, index).values())
            return current(merge(rows, self.spark.read.schema(SCHEMA).parquet(*[f"{folder}/wal/{n}" for n in newer])), mapping, filters), mapping
        if rows is None:
            return current(self.spark.createDataFrame([], SCHEMA), mapping), mapping
        if said.get("mapping") != mapping.to_json():
            return current(rows, mapping, filters), mapping
        at = said["snapshot"]
        live = self.spark.read.parquet(at if "/" in at else f"{folder}/collection/{at}").where("not _deleted")
        return (live.where(~hidden(live, mapping, filters)) if filters else live), mapping

    def query(self, project: str, index: str, request: dict) -> dict:
        """{took, maxScore, total, docs} of {size, query, sort, fields, trackScores, consistentRead, includeVectors}."""
        began = time.time()
        check_size(request.get("size", 10))
        df, mapping = self.collection(project, index, bool(request.get("consistentRead")))
        if request.get("query") is not None:
            read_query(request["query"], mapping)
        sort = request.get("sort")
        hits = search(df, mapping, request.get("query"), request.get("size", 10), sort, None, bool(request.get("trackScores")), keep=("_doc",)).collect()
        docs = [{"index": index, "score": h.score, "doc": self._doc(h, mapping, request)} for h in hits]
        scores = [h.score for h in hits if h.score is not None]
        out = {"took": int((time.time() - began) * 1000), "total": len(docs), "docs": docs}
        return out | ({"maxScore": max(scores, default=-1.0)} if docs else {})

    def fetch(self, project: str, index: str, request: dict) -> dict:
        """{took, total, docs} of {ids, fields, consistentRead, includeVectors}."""
        began = time.time()
        df, mapping = self.collection(project, index, bool(request.get("consistentRead")))
        docs = [{"index": index, "doc": self._doc(h, mapping, request)} for h in fetch(df, mapping, request.get("ids"), keep=("_doc",)).collect()]
        return {"took": int((time.time() - began) * 1000), "total": len(docs), "docs": docs}

    @staticmethod
    def _doc(hit, mapping: Mapping, request: dict) -> dict:
        return pruned(json.loads(hit["_doc"]), request.get("fields"), mapping, bool(request.get("includeVectors")))
