"""The find language: arguments to traversal options, a test tree and actions.

Tests become columns over an entry's row. Short-circuit order matters only for actions
and ``-prune``: each of them is reached under a condition, the conjunction of what its
neighbours to the left came to, and that condition is a column as well. Pruned
directories cut their descendants by an anti join over exploded ancestors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwood.functions import patterns as P
from siftwood.functions.dates import NS, parse_date
from siftwood.functions.modes import parse_mode
from siftwood.plans.printf import compile_format, ls_line

MOST_NESTING, MOST_COMBINATORS = 128, 2000
KINDS = {"f": "file", "d": "dir", "l": "symlink", "p": "fifo", "s": "socket", "b": "block", "c": "character"}
SIZE_UNITS = {"b": 512, "c": 1, "w": 2, "k": 1024, "M": 1 << 20, "G": 1 << 30}
STAMPS = {"a": "atime", "m": "mtime", "c": "ctime", "B": "mtime"}
REFUSED = {"-context", "-files0-from"}
NO_ARGUMENT = {"-noleaf", "-ignore_readdir_race", "-noignore_readdir_race", "-warn", "-nowarn"}


class FindError(ValueError):
    """An expression that the language refuses."""


@dataclass
class Context:
    """What tests may refer to besides the row: now, references by path, time zone."""

    now_ns: int
    zone: str = "UTC"
    references: dict[str, dict] = field(default_factory=dict)
    users: dict[str, int] = field(default_factory=dict)
    groups: dict[str, int] = field(default_factory=dict)

    def reference(self, path: str) -> dict:
        if path not in self.references:
            raise FindError(f"{path}: no such entry")
        return self.references[path]


@dataclass
class Action:
    kind: str
    argument: object = None
    target: str | None = None


@dataclass
class Options:
    most: int | None = None
    least: int = 0
    post_order: bool = False
    one_device: bool = False
    follow: str = "P"
    daystart: bool = False
    dialect: str = "findutils-default"


@dataclass
class Plan:
    starts: list[str]
    options: Options
    expression: tuple
    used: set[str]

    @property
    def has_action(self) -> bool:
        return "action" in self.used


def compare(value: Column, text: str) -> Column:
    """+N greater, -N less, N equal."""
    m = re.fullmatch(r"([+-]?)(\d+)", text)
    if not m:
        raise FindError(f"invalid number {text!r}")
    n = int(m[2])
    return value > n if m[1] == "+" else value < n if m[1] == "-" else value == n


def age_test(delta_ns: Column, text: str, minutes: bool) -> Column:
    """Ages against [+-]N: whole days round down, whole minutes up, fractions are exact."""
    m = re.fullmatch(r"([+-]?)(\d+)(\.\d+)?", text)
    if not m:
        raise FindError(f"invalid age {text!r}")
    unit, sign = (60 if minutes else 86400) * NS, m[1]
    if m[3]:
        n, x = float(m[2] + m[3]), delta_ns / float(unit)
        if minutes:
            return x > n if sign == "+" else x < n if sign == "-" else (x > n - 1) & (x <= n)
        return x > n + 1 if sign == "+" else x < n if sign == "-" else (x >= n) & (x < n + 1)
    n = int(m[2])
    if minutes and sign == "-":
        return delta_ns < n * unit
    # whole numbers, rounded without leaving longs
    down = (delta_ns - F.pmod(delta_ns, F.lit(unit))) / F.lit(unit)
    value = (F.when(F.pmod(delta_ns, F.lit(unit)) == 0, down).otherwise(down + 1) if minutes else down).cast("long")
    return value > n if sign == "+" else value < n if sign == "-" else value == n


def size_test(size: Column, text: str) -> Column:
    """The size in units, rounded up, against [+-]N."""
    m = re.fullmatch(r"([+-]?\d+)([bcwkMG]?)", text)
    if not m:
        raise FindError(f"invalid size {text!r}")
    unit = SIZE_UNITS[m[2] or "b"]
    return compare(F.ceil(size / F.lit(unit)) if unit == 1 else F.floor((size + (unit - 1)) / F.lit(unit)), m[1])


def perm_test(mode: Column, kind: Column, text: str) -> Column:
    how = text[0] if text[:1] in "-/" else ""
    low, high = parse_mode(text[len(how) :]), parse_mode(text[len(how) :], directory=True)

    def one(bits: int) -> Column:
        masked = mode.bitwiseAND(F.lit(0o7777))
        if how == "-":
            return masked.bitwiseAND(F.lit(bits)) == bits
        if how == "/":
            return (masked.bitwiseAND(F.lit(bits)) != 0) if bits else F.lit(True)
        return masked == bits

    return one(low) if low == high else F.when(kind == "dir", one(high)).otherwise(one(low))


def _ns(prefix: str) -> Column:
    return F.col(f"{prefix}_s") * NS + F.col(f"{prefix}_ns")


def _access(bit: int, uid: int = 0) -> Column:
    """Whether any class of users has the bit: what a catalog can know of access(2)."""
    return F.col("mode").bitwiseAND(F.lit(bit << 6 | bit << 3 | bit)) != 0


def build_test(name: str, args: list[str], o: Options, c: Context) -> Column:
    """The column of one test."""
    a = args[0] if args else ""
    if name in ("-name", "-iname"):
        return F.col("name").rlike(P.fnmatch(a, name == "-iname"))
    if name in ("-path", "-wholename", "-ipath", "-iwholename"):
        return F.col("path").rlike(P.fnmatch(a, name[1] == "i"))
    if name in ("-regex", "-iregex"):
        return F.col("path").rlike(P.gnu_regex(a, o.dialect, name == "-iregex"))
    if name in ("-type", "-xtype"):
        letters = a.split(",")
        if len(set(letters)) != len(letters) or not set(letters) <= set(KINDS):
            raise FindError(f"invalid type {a!r}")
        # links to nothing and links that go round stay links
        behind = F.when(F.col("follow_kind") == "loop", "symlink").otherwise(F.col("follow_kind"))
        followed = F.coalesce(behind, F.col("kind")) if name == "-xtype" else F.col("kind")
        return followed.isin(*[KINDS[x] for x in letters])
    if name in ("-lname", "-ilname"):
        return (F.col("kind") == "symlink") & F.coalesce(F.col("target").rlike(P.fnmatch(a, name == "-ilname")), F.lit(False))
    if name == "-perm":
        return perm_test(F.col("mode"), F.col("kind"), a)
    if name == "-size":
        return size_test(F.col("size"), a)
    if m := re.fullmatch("-([amc])(time|min)", name):
        # -daystart measures from the end of today
        base = c.now_ns
        if o.daystart:
            base = parse_date("@" + str(c.now_ns // NS // 86400 * 86400 + 86400), c.now_ns, c.zone)
        return age_test(F.lit(base) - _ns(STAMPS[m[1]]), a, m[2] == "min")
    if name == "-used":
        # days from the last change to the last access
        return age_test(_ns("atime") - _ns("ctime"), a, False) & (_ns("atime") > _ns("ctime"))
    if m := re.fullmatch("-(?:newer([aBcm])([aBcmt])|(a|c)?newer)", name):
        mine = STAMPS[m[1] or m[3] or "m"]
        if m[2] == "t":
            other = parse_date(a, c.now_ns, c.zone)
        else:
            ref, theirs = c.reference(a), STAMPS[m[2] or "m"]
            other = ref[f"{theirs}_s"] * NS + ref[f"{theirs}_ns"]
        return _ns(mine) > other
    if name in ("-links", "-inum", "-uid", "-gid"):
        return compare(F.col({"-links": "nlink", "-inum": "ino", "-uid": "uid", "-gid": "gid"}[name]), a)
    if name in ("-user", "-group"):
        known = c.users if name == "-user" else c.groups
        if a not in known and not a.isdigit():
            raise FindError(f"{a!r} is no known {name[1:]}")
        return F.col("uid" if name == "-user" else "gid") == (known[a] if a in known else int(a))
    if name == "-nouser":
        return F.col("user_name").isNull()
    if name == "-nogroup":
        return F.col("group_name").isNull()
    if name == "-samefile":
        ref = c.reference(a)
        return (F.col("dev") == ref["dev"]) & (F.col("ino") == ref["ino"])
    if name == "-empty":
        return F.when(F.col("kind") == "file", F.col("size") == 0).when(F.col("kind") == "dir", F.coalesce(F.col("entries") == 0, F.lit(False))).otherwise(False)
    if name in ("-readable", "-writable", "-executable"):
        return _access({"-readable": 4, "-writable": 2, "-executable": 1}[name])
    if name == "-fstype":
        return F.coalesce(F.col("fs_type"), F.lit("unknown")) == a
    if name in ("-true", "-false"):
        return F.lit(name == "-true")
    raise FindError(f"unknown predicate {name!r}")


ONE = {
    "-name", "-iname", "-path", "-wholename", "-ipath", "-iwholename", "-regex", "-iregex", "-type", "-xtype", "-lname", "-ilname", "-perm", "-size", "-amin", "-atime", "-cmin", "-ctime",
    "-mmin", "-mtime", "-used", "-newer", "-anewer", "-cnewer", "-links", "-inum", "-uid", "-gid", "-user", "-group", "-samefile", "-fstype",
}
NONE = {"-nouser", "-nogroup", "-empty", "-readable", "-writable", "-executable", "-true", "-false"}


def parse(args: list[str]) -> Plan:
    o, used, at, combinators = Options(), set(), 0, 0
    while at < len(args) and (args[at] in ("-P", "-H", "-L", "-D") or args[at].startswith("-O")):
        if args[at] == "-D":
            at += 1
        elif len(args[at]) == 2 and args[at] != "-O":
            o.follow = args[at][1]
        at += 1
    starts = []
    while at < len(args) and not (args[at].startswith("-") and len(args[at]) > 1) and args[at] not in ("(", ")", "!", ","):
        starts.append(args[at])
        at += 1

    def argument(name: str) -> str:
        nonlocal at
        if at >= len(args):
            raise FindError(f"missing argument to {name}")
        at += 1
        return args[at - 1]

    def combined(node: tuple) -> tuple:
        nonlocal combinators
        combinators += 1
        if combinators > MOST_COMBINATORS:
            raise FindError("expression too large")
        return node

    def comma(depth: int) -> tuple:
        nonlocal at
        node = either(depth)
        while at < len(args) and args[at] == ",":
            at += 1
            node = combined(("comma", node, either(depth)))
        return node

    def either(depth: int) -> tuple:
        nonlocal at
        node = both(depth)
        while at < len(args) and args[at] in ("-o", "-or"):
            at += 1
            node = combined(("or", node, both(depth)))
        return node

    def both(depth: int) -> tuple:
        nonlocal at
        node = single(depth)
        while at < len(args) and args[at] not in ("-o", "-or", ",", ")"):
            if args[at] in ("-a", "-and"):
                at += 1
            node = combined(("and", node, single(depth)))
        return node

    def single(depth: int) -> tuple:
        nonlocal at
        if depth > MOST_NESTING:
            raise FindError("expression nested too deeply")
        if at >= len(args):
            raise FindError("expected an expression")
        name = args[at]
        at += 1
        if name in ("!", "-not"):
            return ("not", single(depth + 1))
        if name == "(":
            if at < len(args) and args[at] == ")":
                raise FindError("empty parentheses")
            node = comma(depth + 1)
            if at >= len(args) or args[at] != ")":
                raise FindError("missing )")
            at += 1
            return node
        if name in (")", ",", "-o", "-or", "-a", "-and"):
            raise FindError(f"{name} without an expression before it")
        if name in REFUSED:
            raise FindError(f"{name} is not supported")
        if name in NO_ARGUMENT:
            return ("const", True)
        if name in ("-maxdepth", "-mindepth"):
            n = argument(name)
            if not n.isdigit() or int(n) > 2**31 - 1:
                raise FindError(f"{name} needs a number")
            setattr(o, "most" if name == "-maxdepth" else "least", int(n))
            return ("const", True)
        if name in ("-depth", "-d"):
            o.post_order = True
            return ("const", True)
        if name in ("-xdev", "-mount"):
            o.one_device = True
            return ("const", True)
        if name == "-follow":
            o.follow = "L"
            return ("const", True)
        if name == "-daystart":
            o.daystart = True
            return ("const", True)
        if name == "-regextype":
            o.dialect = argument(name)
            if o.dialect not in P.DIALECTS:
                raise FindError(f"unknown regular expression type {o.dialect!r}")
            return ("const", True)
        if name == "-prune":
            return ("prune",)
        if name == "-quit":
            used.add("quit")
            return ("action", Action("quit"))
        if name in ("-print", "-print0", "-ls"):
            used.add("action")
            return ("action", Action(name[1:]))
        if name in ("-fprint", "-fprint0", "-fls"):
            used.add("action")
            return ("action", Action(name[2:], target=argument(name)))
        if name == "-printf":
            used.add("action")
            return ("action", Action("printf", argument(name)))
        if name == "-fprintf":
            used.add("action")
            target = argument(name)
            return ("action", Action("printf", argument(name), target))
        if name == "-delete":
            used.add("action")
            o.post_order = True
            return ("action", Action("delete"))
        if name in ("-exec", "-execdir", "-ok", "-okdir"):
            used.add("action")
            command = []
            while (word := argument(name)) != ";" and not (word == "+" and command and command[-1] == "{}"):
                command.append(word)
            return ("action", Action("exec+" if word == "+" else name[1:], tuple(command)))
        if name in ONE or re.fullmatch("-newer[aBcm][aBcmt]", name):
            return ("test", name, [argument(name)], Options(**vars(o)))
        if name in NONE:
            return ("test", name, [], Options(**vars(o)))
        raise FindError(f"unknown predicate {name!r}")

    expression = ("const", True) if at >= len(args) else comma(0)
    if at < len(args):
        raise FindError(f"unexpected {args[at]!r}")
    return Plan(starts or ["."], o, expression, used)


def compile_expression(plan: Plan, context: Context, call=None) -> tuple[Column, Column, list[tuple[Column, Action]]]:
    """(truth, pruned, actions with the condition under which each is reached).

    ``call`` maps an -exec action to the column of its success; without it only plans
    whose truth no command decides are accepted.
    """
    pruned: list[Column] = []
    actions: list[tuple[Column, Action]] = []

    def run(node: tuple, guard: Column) -> Column:
        kind = node[0]
        if kind == "const":
            return F.lit(node[1])
        if kind == "test":
            return F.coalesce(build_test(node[1], node[2], node[3], context), F.lit(False))
        if kind == "not":
            return ~run(node[1], guard)
        if kind == "and":
            left = run(node[1], guard)
            return left & run(node[2], guard & left)
        if kind == "or":
            left = run(node[1], guard)
            return left | run(node[2], guard & ~left)
        if kind == "comma":
            run(node[1], guard)
            return run(node[2], guard)
        if kind == "prune":
            pruned.append(guard)
            return F.lit(True)
        action = node[1]
        actions.append((guard, action))
        if action.kind in ("exec", "execdir", "ok", "okdir"):
            if call is None:
                raise FindError(f"-{action.kind} as a test needs a callable")
            return call(action)
        return F.lit(True)

    truth = run(plan.expression, F.lit(True))
    if not plan.has_action:
        # the whole expression is printed where it holds
        actions.append((truth, Action("print")))
    cut = F.lit(False)
    for p in pruned:
        cut = cut | p
    return truth, F.lit(False) if plan.options.post_order else cut, actions


def ancestors(path: Column) -> Column:
    """All proper ancestors of a path but the root slash."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(2))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def _under(entries: DataFrame, start: str) -> DataFrame:
    """The subtree of one start operand; depth and root count from it."""
    prefix = "" if start == "/" else start.rstrip("/")
    rows = entries.filter((F.col("path") == start) | F.col("path").startswith(prefix + "/"))
    inside = F.size(F.split(F.expr(f"substring(path, {len(prefix) + 1})"), "/")) - 1
    return rows.withColumn("depth", F.when(F.col("path") == start, 0).otherwise(inside).cast("int")).withColumn("root", F.lit(start))


def visited(entries: DataFrame, plan: Plan, pruned: Column) -> DataFrame:
    """The entries that a walk visits: depths, devices and pruned directories applied.
    Start operands are walked one by one; an entry under two of them comes twice."""
    parts = []
    for start in plan.starts:
        rows = entries if start == "." else _under(entries, start)
        cut = pruned
        if plan.options.one_device:
            top = W.partitionBy("root")
            rows = rows.withColumn("__dev", F.max(F.when(F.col("depth") == 0, F.col("dev"))).over(top)) if "__dev" not in rows.columns else rows
            cut = cut | (F.col("dev") != F.coalesce(F.col("__dev"), F.col("dev")))
        closed = rows.filter((F.col("kind") == "dir") & cut).select(F.col("path").alias("__closed")).distinct()
        if str(cut._jc.toString()) != "false":
            below = rows.select("path", F.explode(ancestors(F.col("path"))).alias("__closed")).join(closed, "__closed", "left_semi").select("path").distinct()
            rows = rows.join(below, "path", "left_anti")
        if plan.options.most is not None:
            rows = rows.filter(F.col("depth") <= plan.options.most)
        parts.append(rows.drop("__dev"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_names(entries: DataFrame, users: DataFrame | None = None, groups: DataFrame | None = None, mounts: DataFrame | None = None) -> DataFrame:
    """Dimension columns user_name, group_name (id, name) and fs_type (dev, name)."""
    for table, key, name in ((users, "uid", "user_name"), (groups, "gid", "group_name"), (mounts, "dev", "fs_type")):
        if table is None:
            entries = entries.withColumn(name, F.lit(None).cast("string"))
            continue
        own = table.toDF("__key", name)
        entries = entries.join(own, entries[key] == own["__key"], "left").drop("__key")
    return entries


def with_followed(entries: DataFrame, hops: int = 8) -> DataFrame:
    """The column follow_kind: the kind behind a symlink, ``loop`` where links go round,
    null where the target is missing."""
    directory = F.regexp_replace("path", "/[^/]*$", "")
    at = F.when(F.col("target").startswith("/"), F.col("target")).otherwise(F.concat(directory, F.lit("/"), F.col("target")))
    links = entries.filter("kind = 'symlink'").select("path", at.alias("at"))
    kinds = entries.select(F.col("path").alias("at"), F.col("kind").alias("k"), F.col("target").alias("t"))
    found = None
    for _ in range(hops):
        step = links.join(kinds, "at", "left")
        done = step.filter("k is null or k != 'symlink'").select("path", F.col("k").alias("follow_kind"))
        found = done if found is None else found.union(done)
        base = F.regexp_replace("at", "/[^/]*$", "")
        links = step.filter("k = 'symlink'").select("path", F.when(F.col("t").startswith("/"), F.col("t")).otherwise(F.concat(base, F.lit("/"), F.col("t"))).alias("at"))
    found = found.union(links.select("path", F.lit("loop").alias("follow_kind")))
    return entries.join(found, "path", "left")


def walk_order(plan: Plan) -> Column:
    """Component by component; with -depth a directory comes behind what it holds."""
    parts = F.split("path", "/")
    return F.concat(parts, F.array(F.lit("\U0010ffff"))) if plan.options.post_order else parts


def find(entries: DataFrame, args: list[str], context: Context, call=None) -> DataFrame:
    """path and record (what the action writes) of every action's entries, with action
    and target. ``-quit`` ends the walk at the first entry in walk order that reaches it:
    earlier entries act as ever, that entry as far as its actions stand before it."""
    plan = parse(args)
    _, pruned, actions = compile_expression(plan, context, call)
    for name in ("user_name", "group_name", "fs_type", "follow_kind"):
        # dimensions that weren't joined are unknown
        if name not in entries.columns:
            entries = entries.withColumn(name, F.lit(None).cast("string"))
    rows = visited(entries, plan, pruned)
    if plan.options.least:
        rows = rows.filter(F.col("depth") >= plan.options.least)
    now = context.now_ns // NS
    if "quit" in plan.used:
        ends = F.lit(False)
        for c, a in actions:
            ends = (ends | c) if a.kind == "quit" else ends
        # one row: where the walk ends
        last = rows.filter(ends).select(walk_order(plan).alias("at")).orderBy("at").limit(1).collect()
        if last:
            mark = F.array(*map(F.lit, last[0]["at"]))
            rows = rows.filter(walk_order(plan) <= mark)
            reached, kept = F.lit(False), []
            for c, a in actions:
                if a.kind == "quit":
                    reached = reached | c
                else:
                    kept.append((c & ~((walk_order(plan) == mark) & reached), a))
            actions = kept
        else:
            actions = [(c, a) for c, a in actions if a.kind != "quit"]
        if not actions:
            return rows.limit(0).select("path", F.lit("").alias("record"), F.lit(0).alias("action"), F.lit(None).cast("string").alias("target"))
    outs = []
    for number, (condition, action) in enumerate(actions):
        if action.kind == "print":
            record = F.concat(F.col("path"), F.lit("\n"))
        elif action.kind == "print0":
            record = F.concat(F.col("path"), F.decode(F.unhex(F.lit("00")), "UTF-8"))
        elif action.kind == "ls":
            record = F.concat(ls_line(now), F.lit("\n"))
        elif action.kind == "printf":
            record = compile_format(action.argument)
        elif action.kind == "delete":
            record = F.concat(F.lit("delete "), F.col("path"))
            condition = condition & (F.col("path") != ".")
        else:
            record = F.col("path")
        outs.append(rows.filter(condition).select("path", record.alias("record"), F.lit(number).alias("action"), F.lit(action.target).cast("string").alias("target")))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out


def paths(entries: DataFrame, args: list[str], context: Context) -> DataFrame:
    """The paths for which the expression prints."""
    return find(entries, args, context).select("path")


def write_targets(found: DataFrame, folder: str) -> None:
    """-fprint and its kin: one text output below ``folder`` for each target file."""
    found.filter("target is not null").select("target", F.regexp_replace("record", "\n$", "").alias("value")).write.mode("overwrite").partitionBy("target").text(folder)


def delete_plan(found: DataFrame) -> DataFrame:
    """Deletions deepest first, as change records; nothing is touched."""
    return found.select(F.lit("NameDelete").alias("kind"), "path", F.size(F.split("path", "/")).alias("level")).orderBy(F.desc("level"), F.desc("path"))


def exec_batches(found: DataFrame, command: list[str], budget: int = 128 << 10, in_directory: bool = False) -> DataFrame:
    """-exec CMD {} +: argument lists within a byte budget, directory by directory (so
    that no task orders the whole result). ``in_directory`` is -execdir: the arguments are
    ./name, to be run in their parent."""
    if in_directory:
        found = found.withColumn("argument", F.concat(F.lit("./"), F.regexp_extract("path", "([^/]*)$", 1)))
    else:
        found = found.withColumn("argument", F.col("path"))
    cost = F.octet_length("argument") + 1 + 8
    w = W.partitionBy("parent").orderBy("path").rowsBetween(W.unboundedPreceding, W.currentRow)
    fixed = sum(len(c.encode()) + 9 for c in command if c != "{}")
    rows = found.select(F.regexp_replace("path", "/[^/]*$", "").alias("parent"), "path", "argument").withColumn("batch", F.floor((F.sum(cost).over(w) - cost) / F.lit(max(1, budget - fixed))))
    return rows.groupBy("parent", "batch").agg(F.sort_array(F.collect_list("argument")).alias("arguments"))
