"""Files to tables to answers: the catalog, its lifecycle and the calls over it.

Any number of files are ingested by one set of jobs: tables of one layout are
made and written together.  Rows are written as Parquet first, catalog entries
next, and the datasets' entries last, so a dataset that is seen is whole.  Entries are appended;
a dataset's latest entry counts.  What is kept in the session (answers and plans)
holds for one state of the catalog, so another session on the same folder sees
the same.
"""

from __future__ import annotations

import contextlib
import copy
import datetime as dt
import functools
import posixpath
import re
import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable, Hashable
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dashboard as boards
from . import lexicon, nlq, report
from .errors import AmbiguousQuery, EngineError, FileTooLarge, IngestFailed, NotFound, StorageBusy, Unanswerable
from .narration import Answer, narrate
from .functions.scalars import MISSING
from .operators import profile
from .plans.plan import compile_plan
from .sources import ingest as ing
from .sources import workbook
from .sources.columns import SAMPLE, identifier

DATASET = "dataset_id string, filename string, content_hash string, layout_fingerprint string, as_of_date string, ingest_version long, ingested_at string, row_count long, status string, at long"
TABLE = "table_id string, dataset_id string, sheet string, block_id int, kind string, physical_name string, cell_range string, row_count long, confidence double, context map<string,string>, place string"
COLUMN = (
    "table_id string, dataset_id string, ordinal int, name string, slug string, role string, kind string, unit string, derived boolean, derived_of array<string>, null_fraction double, sample array<string>, distinct long"
)
CHECKSUM = "table_id string, dataset_id string, column_slug string, stated_total double, parsed_total double, agrees boolean"
RECIPE = "layout_fingerprint string, no int, recipe string, at long"
SKETCH = "table_id string, dataset_id string, slug string, rows long, sketch binary"
SCHEMAS = {"dataset": DATASET, "table": TABLE, "column": COLUMN, "checksum": CHECKSUM, "recipe": RECIPE, "sketch": SKETCH, "posting": lexicon.POSTING, "lex_stat": lexicon.STATISTICS}
#: Values that one question may name; more are asked back.
NAMED = 1000
#: Times the catalog's lock is tried, and the seconds waited after the first, doubled, tripled and so on.
TRIES, WAIT = 5, 0.4
#: Seconds after which a lock that is not renewed is a dead writer's.
LEASE = 600
UPLOAD_MB = 256
#: Columns that the search for a question's tables may give.
CANDIDATES = 48
#: Answers and plans kept, the latest used.
ANSWERS, PLANS = 256, 512


class Warehouse:
    def __init__(self, spark: SparkSession, root: str, upload_mb: int = UPLOAD_MB):
        self.spark, self.root, self.upload_mb = spark, root.rstrip("/"), upload_mb
        self._answers, self._plans = OrderedDict(), OrderedDict()

    # catalog

    def _at(self, path: str):
        """The path in Hadoop's terms, and its file system."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _entries(self, name: str) -> DataFrame:
        at, fs = self._at(path := f"{self.root}/catalog/{name}")
        if not fs.exists(at):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(path)

    def _live(self, name: str) -> DataFrame:
        """The entries of active datasets."""
        return self._entries(name).join(self._state().where("status = 'active'").select("dataset_id"), "dataset_id", "left_semi")

    @contextlib.contextmanager
    def _alone(self, tries: int = TRIES):
        """Holds the catalog's lock, a file that one writer alone can make; StorageBusy after ``tries``.

        The file is renewed as long as it is held; one that was not for ``LEASE``
        seconds is a dead writer's and is moved away, which one taker alone can do.
        """
        at, fs = self._at(f"{self.root}/catalog/_lock")
        k = 0
        while not fs.createNewFile(at):
            if self._dead(at, fs):
                continue
            if (k := k + 1) == tries:
                raise StorageBusy("another writer holds the catalog")
            time.sleep(WAIT * k)
        done = threading.Event()

        def renew() -> None:
            while not done.wait(LEASE / 10):
                fs.create(at, True).close()

        keeper = threading.Thread(target=renew, daemon=True)
        keeper.start()
        try:
            yield
        finally:
            done.set()
            keeper.join()
            fs.delete(at, False)

    def _dead(self, at, fs) -> bool:
        """Whether the lock's writer died; then the lock is gone."""
        with contextlib.suppress(Py4JJavaError):  # it may go meanwhile
            if time.time() - fs.getFileStatus(at).getModificationTime() / 1000 > LEASE:
                gone, _ = self._at(f"{self.root}/catalog/_dead-{uuid.uuid4().hex}")
                return bool(fs.rename(at, gone)) and fs.delete(gone, False)
        return False

    def unlock(self) -> None:
        """Removes the lock of a writer that died, before its lease ends."""
        self._remove(f"{self.root}/catalog/_lock")

    def _add(self, name: str, rows: list[dict]) -> None:
        if rows:
            order = [f.split()[0] for f in SCHEMAS[name].split(", ")]
            df = self.spark.createDataFrame([tuple(r.get(k) for k in order) for r in rows], SCHEMAS[name])
            df.coalesce(1).write.mode("append").parquet(f"{self.root}/catalog/{name}")

    def _state(self) -> DataFrame:
        d = self._entries("dataset")
        return d.groupBy("dataset_id").agg(F.max_by(F.struct(*d.columns), "at").alias("x")).select("x.*")

    def version(self) -> tuple:
        """Differs once a dataset came, went or changed its state."""
        return tuple(self._entries("dataset").agg(F.count("*"), F.max("at"), F.sum("row_count")).first())

    def datasets(self) -> list[dict]:
        return [r.asDict() for r in self._state().where("status <> 'cleared'").orderBy(F.desc("ingested_at"), "dataset_id").collect()]

    def tables(self, dataset_id: str | None = None) -> list[dict]:
        """Tables of active datasets, the latest first, each with its columns."""
        return self._tables(F.lit(True) if dataset_id is None else F.col("dataset_id") == dataset_id)

    def _tables(self, which) -> list[dict]:
        """As ``tables``, for the entries that a condition on table_id, dataset_id or physical_name picks; no others are collected."""
        live = self._state().where("status = 'active'").select("dataset_id", "filename", "as_of_date", "ingested_at")
        picked = self._entries("table").where(which)
        cols = self._entries("column").join(picked.select("table_id"), "table_id", "left_semi")
        own = cols.groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", *[c for c in cols.columns if c not in ("ordinal", "table_id", "dataset_id")]))).alias("columns"))
        out = picked.join(live, "dataset_id").join(own, "table_id").orderBy(F.desc("ingested_at"), "filename", "sheet", "block_id")
        return [r.asDict(recursive=True) for r in out.collect()]

    def files(self) -> DataFrame:
        """A row for each file with active tables: filename, dataset_id and as_of_date of its first dataset, tables, rows."""
        live = self._state().where("status = 'active'").select("dataset_id", "filename", "as_of_date")
        per = self._entries("table").join(live, "dataset_id").groupBy("filename")
        return per.agg(F.min("dataset_id").alias("dataset_id"), F.min("as_of_date").alias("as_of_date"), F.count("*").alias("tables"), F.sum("row_count").alias("rows"))

    def _table(self, table_id: str) -> dict:
        found = self._tables(F.col("table_id") == table_id)
        if not found:
            raise NotFound(f"no table {table_id!r}")
        return found[0]

    def frame(self, table_id: str) -> DataFrame:
        return self._frame(self._table(table_id))

    def _frame(self, t: dict) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{t['place']}")

    def _frames(self, tables: list[dict]) -> DataFrame:
        """The rows of tables of one layout, with ``table_id``; one scan."""
        rows = self.spark.read.parquet(*[f"{self.root}/{t['place']}" for t in tables])
        place = F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), r"(data/\w+/\d+/_physical=\w+)/[^/]*$", 1)
        ids = self.spark.createDataFrame([(t["place"], t["table_id"]) for t in tables], "_place string, table_id string")
        return rows.withColumn("_place", place).join(ids, "_place").drop("_place")

    def table_exists(self, name: str) -> bool:
        return bool(self._tables((F.col("table_id") == name) | (F.col("physical_name") == name)))

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over the active tables that the text names by physical name; ``sql(...).first()[0]`` is a scalar."""
        said = sorted(set(re.findall(r"\w+", text.lower())))
        for t in self._tables(F.lower("physical_name").isin(*said)):
            self._frame(t).createOrReplaceTempView(t["physical_name"])
        return self.spark.sql(text)

    # files

    def analyse(self, path: str) -> dict:
        """What ingest would find, without writing; only the rows that tables are looked for in are parsed."""
        recipes = ing.analyse(workbook.cells(self.spark, path, workbook.PROBE_ROWS + SAMPLE))
        return {"layout_fingerprint": ing.fingerprint(recipes), "recipes": [r.to_dict() for r in recipes]}

    def ingest(self, path: str, as_of: dt.date | str | None = None, layout: str | None = None, missing: tuple[float, ...] = MISSING) -> dict:
        """One file; see ``ingest_many``.  A file that is refused raises."""
        (done,) = self.ingest_many([path], as_of, layout, missing)
        if "error" in done:
            raise done["error"]
        return done

    def ingest_many(self, paths: list[str], as_of: dt.date | str | None = None, layout: str | None = None, missing: tuple[float, ...] = MISSING) -> list[dict]:
        """A result for each file, in their order; one that is refused has its ``error`` and stops no other.

        The number of Spark jobs depends on the number of different layouts, not
        on that of files.  With ``layout``, a stored layout's fingerprint, its
        tables are looked for by their headers instead of anew.  ``missing`` are
        the numbers that stand for a missing value in these files, none for files
        without such codes; a stored layout keeps its own.
        """
        as_of, out = str(as_of or dt.date.today()), {}
        taken = [p for p in paths if p.lower().endswith(workbook.SUFFIXES)]
        out |= {p: {"error": IngestFailed(f"no reader for {posixpath.basename(p)!r}", suffixes=list(workbook.SUFFIXES))} for p in paths if p not in taken}
        if not taken:
            return [out[p] for p in paths]
        found = {_plain(x["path"]): x for x in workbook.stats(self.spark, taken, self.upload_mb * 2**20)}
        where = {p: found.get(_plain((at := self._at(p))[1].makeQualified(at[0]).toString())) for p in taken}
        for p, x in where.items():
            if x is None:
                out[p] = {"error": IngestFailed(f"{posixpath.basename(p)!r} is empty")}
            elif x["hash"] is None:
                out[p] = {"error": FileTooLarge(f"{x['length']} bytes; at most {self.upload_mb} MB are taken")}
        left = [p for p in where if p not in out]
        while left:  # one round, unless files of one name, which are versions of it, come together
            earlier, todo = self.datasets(), {}
            for p in left:
                if posixpath.basename(p) in {posixpath.basename(q) for q in todo}:
                    continue
                if done := self._done(earlier, posixpath.basename(p), where[p]["hash"], as_of):
                    out[p] = done
                else:
                    todo[p] = where[p]
            out |= self._ingest(todo, as_of, layout, missing) if todo else {}
            left = [p for p in left if p not in out]
        return [out[p] for p in paths]

    @staticmethod
    def _done(earlier: list[dict], name: str, digest: str, as_of: str) -> dict | None:
        """The result of an ingest that has nothing to do."""
        d = next((d for d in earlier if (d["filename"], d["content_hash"], d["as_of_date"], d["status"]) == (name, digest, as_of, "active")), None)
        return d and {"dataset_id": d["dataset_id"], "already_ingested": True, "total_rows": 0, "tables": []}

    def _remove(self, folder: str) -> None:
        at, fs = self._at(folder)
        fs.delete(at, True)

    def _recipes(self, layout: str) -> list[ing.Recipe]:
        rows = self._entries("recipe").where(F.col("layout_fingerprint") == layout).groupBy("no").agg(F.max_by("recipe", "at").alias("recipe")).orderBy("no").collect()
        if not rows:
            raise NotFound(f"no stored layout {layout!r}")
        return [ing.Recipe.from_json(r["recipe"]) for r in rows]

    def _ingest(self, files: dict[str, dict], as_of: str, layout: str | None, missing: tuple[float, ...]) -> dict[str, dict]:
        """Results by path of files of different names; path -> path, length and hash as found."""
        stored = self._recipes(layout) if layout else None
        batch = uuid.uuid4().hex
        scratch = f"{self.root}/cells/{batch}"
        try:
            # files are parsed once; everything else reads this copy
            workbook.cells(self.spark, list(files)).write.parquet(f"{scratch}/cells")
            cells = self.spark.read.schema(workbook.SCHEMA).parquet(f"{scratch}/cells")
            with self._alone():
                earlier = self.datasets()  # as it is now that no other writer is at work
                out = {p: done for p, x in files.items() if (done := self._done(earlier, posixpath.basename(p), x["hash"], as_of))}
                try:
                    recipes = ing.replay(cells, stored) if stored else ing.analyse(cells, missing)
                except IngestFailed as e:
                    return {p: {"error": e} for p in files} | out
                by_path: dict[str, list[ing.Recipe]] = {}
                for r in recipes:
                    by_path.setdefault(_plain(r.path), []).append(r)
                new = {p: by_path[_plain(x["path"])] for p, x in files.items() if p not in out and _plain(x["path"]) in by_path}
                out |= {p: {"error": IngestFailed("no table was found in this file")} for p in files if p not in out and p not in new}
                return out | (self._store(cells, {p: (files[p], rs) for p, rs in new.items()}, earlier, batch, scratch, as_of) if new else {})
        finally:
            self._remove(scratch)

    def _store(self, cells: DataFrame, files: dict[str, tuple[dict, list[ing.Recipe]]], earlier: list[dict], batch: str, scratch: str, as_of: str) -> dict[str, dict]:
        """Writes rows, then what the catalog holds of them, then the datasets."""
        rs, tables, held = [], [], []
        dataset = {p: uuid.uuid4().hex for p in files}
        for p, (_, own) in files.items():
            for no, r in enumerate(own):
                physical = identifier(f"f_{dataset[p][:8]}_{r.sheet}_{r.block}")
                tables.append(dict(
                    table_id=f"{dataset[p][:8]}_{no}", dataset_id=dataset[p], sheet=r.sheet, block_id=r.block, kind=r.kind, physical_name=physical, cell_range=r.range,
                    confidence=r.confidence, context={s: v for s, _, v in r.context}, path=p,
                ))
                rs.append(r)
                held.append(ing.stored_columns(r))
        ids = self.spark.createDataFrame([(t["physical_name"], t["table_id"]) for t in tables], "_physical string, table_id string")
        about = lambda t, c: " ".join([c.name, c.slug.replace("_", " "), *nlq.synonyms(c.slug), c.unit or "", t["sheet"], posixpath.splitext(posixpath.basename(t["path"]))[0].replace("_", " ")])
        entries = [lexicon.of_columns(self.spark, [(t["table_id"], c.slug, c.name, about(t, c), t["dataset_id"]) for t, cols in zip(tables, held) for c in cols])]
        sketches, checks = [], []
        for g, group in enumerate(ing.by_layout(rs)):
            place = f"data/{batch}/{g}"
            keys = [(tables[i]["dataset_id"], as_of, tables[i]["physical_name"]) for i in group]
            ing.tables(cells, [rs[i] for i in group], keys).hint("rebalance", "_physical").write.partitionBy("_physical").parquet(f"{self.root}/{place}")
            rows = self.spark.read.parquet(f"{self.root}/{place}").withColumn("_physical", F.col("_physical").cast("string")).join(ids, "_physical")
            dims = [c.slug for c in held[group[0]] if c.role in ("dimension", "identifier")]
            if dims:
                entries.append(lexicon.of_values(rows, F.col("table_id"), dims, F.col("_dataset_id")))
            sketches.append(profile.sketches(rows, ["table_id", "_dataset_id"], dims).withColumnRenamed("_dataset_id", "dataset_id"))
            for i in group:
                tables[i]["place"] = f"{place}/_physical={tables[i]['physical_name']}"
            checks += [x | {k: tables[group[i]][k] for k in ("table_id", "dataset_id")} for i, x in ing.checksums(cells, [rs[i] for i in group])]
        order = [f.split()[0] for f in SKETCH.split(", ")]
        functools.reduce(DataFrame.unionAll, [x.select(*order) for x in sketches]).coalesce(1).write.mode("append").parquet(f"{self.root}/catalog/sketch")
        functools.reduce(DataFrame.unionAll, [e.select(*[f.split()[0] for f in lexicon.ENTRY.split(", ")]) for e in entries]).write.parquet(f"{scratch}/entries")
        said = self.spark.read.parquet(f"{scratch}/entries")
        lexicon.in_order(lexicon.postings(said)).write.mode("append").parquet(f"{self.root}/catalog/posting")
        lexicon.statistics(said).coalesce(1).write.mode("append").parquet(f"{self.root}/catalog/lex_stat")
        counts = {r[0]: r[1] for r in self._entries("sketch").where(F.col("dataset_id").isin(*dataset.values()) & (F.col("slug") == "")).select("table_id", "rows").collect()}
        distinct = {(r[0], r[1]): r[2] for r in said.where("kind = 'value'").groupBy("table_id", "slug").count().collect()}
        columns = [c.to_dict() | dict(table_id=t["table_id"], dataset_id=t["dataset_id"], ordinal=k, distinct=distinct.get((t["table_id"], c.slug))) for t, cols in zip(tables, held) for k, c in enumerate(cols)]
        for t in tables:
            t["row_count"] = counts.get(t["table_id"], 0)
        now = time.time_ns()
        layouts = {ing.fingerprint(own): own for _, own in files.values()}
        fresh = set(layouts) - {r[0] for r in self._entries("recipe").where(F.col("layout_fingerprint").isin(*layouts)).select("layout_fingerprint").distinct().collect()}
        self._add("recipe", [{"layout_fingerprint": f, "no": no, "recipe": r.to_json(), "at": now} for f in sorted(fresh) for no, r in enumerate(layouts[f])])
        self._add("table", tables)
        self._add("column", columns)
        self._add("checksum", checks)
        commits, out = [], {}
        for p, (x, own) in files.items():
            older = [d for d in earlier if d["filename"] == posixpath.basename(p) and d["as_of_date"] == as_of]
            mine = [{k: v for k, v in t.items() if k != "path"} for t in tables if t["path"] == p]
            total = sum(t["row_count"] for t in mine)
            # written together: the new dataset appears as the older ones go
            commits.append(dict(
                dataset_id=dataset[p], filename=posixpath.basename(p), content_hash=x["hash"], layout_fingerprint=ing.fingerprint(own), as_of_date=as_of, ingested_at=dt.datetime.now(dt.UTC).isoformat(),
                ingest_version=max((d["ingest_version"] for d in older), default=0) + 1, row_count=total, status="active", at=now,
            ))
            commits += [d | {"status": "superseded", "at": now} for d in older if d["status"] == "active"]
            out[p] = {"dataset_id": dataset[p], "already_ingested": False, "total_rows": total, "tables": mine, "checksums": [c for c in checks if c["dataset_id"] == dataset[p]]}
        self._add("dataset", commits)
        return out

    def retire(self, dataset_id: str) -> None:
        with self._alone():
            d = next((d for d in self.datasets() if d["dataset_id"] == dataset_id), None)
            if d is None:
                raise NotFound(f"no dataset {dataset_id!r}")
            self._add("dataset", [d | {"status": "retired", "at": time.time_ns()}])

    def clear(self) -> int:
        """Forgets all datasets, then deletes their rows."""
        with self._alone():
            gone, now = self.datasets(), time.time_ns()
            self._add("dataset", [d | {"status": "cleared", "at": now} for d in gone])
            for folder in ("data", *(f"catalog/{n}" for n in ("posting", "lex_stat", "sketch"))):
                self._remove(f"{self.root}/{folder}")
        return len(gone)

    def health(self) -> dict:
        r = self._state().where("status = 'active'").agg(F.count("*").alias("n"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows")).first()
        return {"status": "ok", "datasets": r["n"], "rows": r["rows"]}

    # questions

    def search(self, text: str, k: int = 24, kind: str | None = None) -> list[dict]:
        """The columns and values of active tables that a text may mean, the best first."""
        return [r.asDict() for r in lexicon.search(self._live("posting"), self._live("lex_stat"), nlq.telling(text), k, kind).collect()]

    def _asker(self, question: str, table_id: str | None) -> nlq.Asker:
        """Over the tables whose columns score best for the question's words or, if none does, have a word that begins like one of them."""
        if table_id:
            ids = [table_id]
        else:
            words = nlq.telling(question)
            find = lambda ws: list(dict.fromkeys(r["table_id"] for r in lexicon.search(self._live("posting"), self._live("lex_stat"), ws, CANDIDATES, "column").collect()))
            ids = find(words) or find(sorted({w[: nlq.FIRST_LETTERS] for w in words if len(w) >= nlq.FIRST_LETTERS}))
        which, named = F.col("table_id").isin(*ids), {}
        if set(nlq.DEPARTURES) & set(question.lower().split()):
            which = which | F.lower("sheet").contains("normal")
        for t in self._tables(which) if ids else []:
            cols = []
            for c in t["columns"]:
                words = nlq._words(c["name"]) + ([] if c["role"] != "measure" or c["slug"] != "value" else nlq._words(t["sheet"]))
                role = "dimension" if c["role"] == "identifier" else c["role"]
                units = {"mm", "c", "degc", "percent", "hpa"}
                cols.append(nlq.Column(c["slug"], role, tuple(w for w in words if w not in units) or (c["slug"],), c["unit"] or "", nlq.synonyms(c["slug"]), c["name"], (t["sheet"], posixpath.splitext(t["filename"])[0])))
            named[t["table_id"]] = (functools.partial(self._frame, t), tuple(cols))
        normals = tuple(k for k, (_, cols) in named.items() if any("normal" in p.lower() for p in cols[0].places))
        return nlq.Asker(named, _Stored(self, question), normals)

    def resolve(self, question: str, table_id: str | None = None) -> dict:
        table, plan = self._plan(question, table_id, self.version())
        return {"table_id": table, "plan": plan}

    def _plan(self, question: str, table_id: str | None, version: tuple):
        key = (version, question.strip().lower(), table_id)
        return _kept(self._plans, key, PLANS, lambda: self._asker(question, table_id).resolve(question, table_id))

    def ask(self, question: str, table_id: str | None = None, normal: float | None = None) -> Answer:
        """The answer in one sentence and its rows; asked again of the same catalog, it is the one kept."""
        version = self.version()
        key = (version, question.strip().lower(), table_id, normal)
        return copy.deepcopy(_kept(self._answers, key, ANSWERS, lambda: self._ask(question, table_id, normal, version)))

    def _ask(self, question: str, table_id: str | None, normal: float | None, version: tuple) -> Answer:
        if not version[0]:
            raise Unanswerable("no file has been ingested")
        if table_id:
            self._table(table_id)
        table, plan = self._plan(question, table_id, version)
        t = self._table(table)
        rows = [r.asDict() for r in compile_plan(self._frame(t), plan, plan.normals and self.frame(plan.normals.table)).collect()]
        by_slug = {c["slug"]: c for c in t["columns"]}
        m = by_slug[plan.measure]
        source = f"{t['filename']} · {t['sheet']} · {t['physical_name']} · as of {t['as_of_date']}"
        a = narrate(plan, rows, m["name"], m["unit"], source, {k: c["name"] for k, c in by_slug.items()}, normal)
        a.table_id = table
        a.assumptions += plan.notes
        if not any(w in question.lower() for _, words in nlq.AGGREGATE_WORDS for w in words):
            a.assumptions.append(f"No aggregate was named, so the {plan.aggregation} was taken.")
        return a

    def suggestions(self) -> list[str]:
        out = []
        for t in self.tables()[:4]:
            measures = [c for c in t["columns"] if c["role"] == "measure" and not c["derived"]]
            dims = [c for c in t["columns"] if c["role"] == "dimension" and (c["distinct"] or 0) > 1]
            for m in measures[:1]:
                name = m["name"].lower()
                out.append(f"total {name}")
                out += [f"average {name} by {d['name'].lower()}" for d in dims[:1]] + [f"top 5 {d['name'].lower()} by {name}" for d in dims[:1]]
                if any(c["slug"] == "period_month" for c in t["columns"]):
                    out.append(f"average {name} in monsoon")
        return list(dict.fromkeys(out))[:8]

    # views

    def preview(self, table_id: str, rows: int = 50) -> list[dict]:
        return [r.asDict() for r in self.frame(table_id).limit(max(1, min(rows, 1000))).collect()]

    def profile(self, table_id: str) -> dict:
        t = self._table(table_id)
        df = self._frame(t)
        measures = [c for c in t["columns"] if c["role"] == "measure"]
        dims = [c for c in t["columns"] if c["role"] in ("dimension", "identifier")]
        stats = [r.asDict() for r in profile.measures(df, [c["slug"] for c in measures]).collect()] if measures else []
        middle = profile.medians(df, [c["slug"] for c in measures])
        for s in stats:
            s["median"] = middle[s["measure"]]
        counts, tops = {c["slug"]: 0 for c in dims}, {c["slug"]: [] for c in dims}
        for r in profile.tops(df, list(counts)).collect() if dims else []:
            if r["no"] is None:
                counts[r["slug"]] = r["n"]
            else:
                tops[r["slug"]].append({"value": r["value"], "n": r["n"]})
        checks = [r.asDict() for r in self._entries("checksum").where(F.col("table_id") == table_id).collect()]
        return {"table_id": table_id, "measures": stats, "distinct": counts, "top": tops, "checksums": checks, "narrative": story(t, stats, counts, checks), "suggested": boards.suggest(t["columns"])}

    def distinct(self, slug: str, table_id: str | None = None) -> float | None:
        """About how many different values a column has over all active tables, or in one, from stored sketches; no row is read.

        The standard error is about 1.6 % (exact for few values); ``profile`` counts exactly.
        """
        s = self._live("sketch").where(F.col("slug") == slug)
        got = (s.where(F.col("table_id") == table_id) if table_id else s).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch"))).first()[0]
        return got

    def dashboard(self, most: int = boards.MOST_CHARTS) -> list[dict]:
        """Two jobs for all tables of one layout, however many."""
        alike: dict[tuple, list[dict]] = {}
        for t in self.tables():
            alike.setdefault(boards.layout(t["columns"]), []).append(t)
        found = []
        for ts in alike.values():
            found += boards.charts(self._frames(ts), {t["table_id"]: f"{t['filename']} / {t['sheet']}" for t in ts}, ts[0]["columns"])
        return [c.to_dict() for c in boards.ranked(found, most)]

    def report(self, title: str, questions: list[str]) -> str:
        """HTML; a question that can't be answered becomes a caveat."""
        answers, caveats = [], []
        for q in questions:
            try:
                answers.append((q, self.ask(q).to_dict()))
            except EngineError as e:
                caveats.append(f"{q}: {e.message}")
        sources = [f"{d['filename']} as of {d['as_of_date']}, {d['row_count']} rows" for d in self.datasets() if d["status"] == "active"]
        return report.render(title, answers, self.dashboard(), sources, caveats)


def _plain(path: str) -> str:
    """A path as all of Spark's readers may write it: without escapes, and with one slash after its scheme."""
    return re.sub(r"^([A-Za-z][A-Za-z0-9+.-]*):/+", r"\1:/", unquote(path))


class _Stored:
    """The values of stored tables, looked up in their postings, which have every value of a dimension."""

    complete = True

    def __init__(self, house: Warehouse, question: str):
        self.house, self.said = house, nlq.spellings(question)

    def _of(self, table: str) -> DataFrame:
        return self.house._live("posting").where(F.col("table_id") == table)

    def named(self, table: str, words: set[str]) -> dict[str, tuple[str, ...]]:
        rows = lexicon.named(self._of(table), self.said).limit(NAMED + 1).collect()
        if len(rows) > NAMED:
            raise AmbiguousQuery(f"the question names more than {NAMED} values", candidates=sorted({r["slug"] for r in rows})[:4])
        out: dict[str, tuple[str, ...]] = {}
        for r in sorted(rows, key=lambda r: (r["slug"], r["target"])):
            if (w := set(nlq._words(r["target"]))) and w <= words:
                out[r["slug"]] = (*out.get(r["slug"], ()), r["target"])
        return out

    def near(self, table: str, words: list[str]) -> dict[str, list[tuple[str, str]]]:
        rows = lexicon.near(self._of(table), words, nlq.ALIKE, nlq.FIRST_LETTERS, nlq.RESCUED).collect()
        return {w: [(r["slug"], r["target"]) for r in rs] for w, rs in lexicon.rows_by_word(rows).items()}


def _kept(cache: OrderedDict, key: Hashable, most: int, make: Callable):
    if key not in cache:
        cache[key] = make()
    cache.move_to_end(key)
    while len(cache) > most:
        cache.popitem(last=False)
    return cache[key]


def story(t: dict, stats: list[dict], counts: dict, checks: list[dict]) -> list[str]:
    names = {c["slug"]: c["name"] for c in t["columns"]}
    out = [f"{t['sheet']} holds {t['row_count']} rows from {t['cell_range']}."]
    for s in stats:
        if s["n"]:
            out.append(f"{names[s['measure']]} runs from {s['lo']:g} to {s['hi']:g}, with a mean of {s['mean']:.4g}.")
        if s["missing"]:
            out.append(f"{names[s['measure']]} is missing in {100 * s['missing'] / s['total_rows']:.1f}% of rows.")
    if stats and stats[0]["traces"]:
        out.append(f"{stats[0]['traces']} rows are traces, kept as 0.0.")
    out += [f"{names[k]} has {n} distinct values." for k, n in counts.items() if n > 1]
    bad = [c["column_slug"] for c in checks if not c["agrees"]]
    if checks:
        out.append(f"Stated totals agree for {len(checks) - len(bad)} of {len(checks)} columns" + (f"; not for {', '.join(bad)}." if bad else "."))
    return out
