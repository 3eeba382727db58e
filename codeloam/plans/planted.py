"""Small hand-written texts with known weaknesses. The invented tables hold none, so the queries of the security operators
read these beside the tables; what must be found in them was worked out by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TEXTS = [
    (-1, "python", "def find_user(request, name):\n    sql = 'SELECT id FROM users WHERE name = ' + name\n    return db.execute(sql)\n"),
    (-2, "python", "def show(path):\n    full = os.path.basename(path)\n    return open('/srv/' + full)\n"),
    (-3, "python", "def load(blob):\n    return pickle.loads(blob)\n"),
    (-4, "python", "def run_it(command):\n    go = os.system\n    go(command)\n"),
    (-5, "python", "def eval(text):\n    return text\n"),
    (-6, "python", "def pick():\n    return random.randint(1, 6)\n"),
    (-7, "javascript", "function paint(label) {\n  box.innerHTML = '<b>' + label;\n}\n"),
    (-8, "python", "def at(rows, i):\n    rows.append(0)\n    return rows[i]\n"),
    (-9, "python", "def at(rows, i):\n    rows.append(0)\n    if i < len(rows):\n        return rows[i]\n"),
    (-10, "python", "def digest(text):\n    return hashlib.md5(text)\n"),
    (-11, "python", "def fetch(address):\n    if not address.startswith('https://own.example/'):\n        raise ValueError(address)\n    return requests.get(address)\n"),
    (-12, "python", "def fetch(address):\n    return requests.get(address)\n"),
]

RISKY = [
    (-21, "python", "def go(url):\n    target = url\n    return redirect(target)\n"),
    (-22, "python", "def note(text):\n    logger.info('a' + text)\n    logger.info('a\\n' + text)\n"),
    (-23, "python", "def home(url):\n    return redirect('/home')\n"),
    (-24, "python", "def enter(user):\n    try:\n        verify(user)\n    except Exception:\n        return True\n"),
    (-25, "python", "def quiet(path):\n    try:\n        drop(path)\n    except:\n        pass\n"),
    (-26, "python", "def label(key):\n    row = db.find(key)\n    return row.name\n"),
    (-27, "python", "def label(key):\n    row = db.find(key)\n    if row is None:\n        return ''\n    return row.name\n"),
    (-28, "python", "def deny(word):\n    raise ValueError('bad password ' + word)\n"),
    (-29, "python", "def read(params):\n    return params['page']\n"),
]

TYPED = [
    (-41, "python", "def total(xs: list, n: int) -> int:\n    return sum(xs) + n\n\ndef go(k):\n    rows = [1, 2]\n    total('a', 3)\n    total(rows, k)\n    return total(4, rows)\n"),
]


def typed(spark: SparkSession) -> DataFrame:
    """(fn_id, lang, code) of a text whose calls have a wrong, a right and a swapped order of arguments."""
    return spark.createDataFrame(TYPED, "fn_id bigint, lang string, code string")


def risky(spark: SparkSession) -> DataFrame:
    """(fn_id, lang, code) of texts with framework sinks and mishandled errors."""
    return spark.createDataFrame(RISKY, "fn_id bigint, lang string, code string")


def planted(spark: SparkSession) -> DataFrame:
    """(fn_id, lang, code) of the hand-written texts."""
    return spark.createDataFrame(TEXTS, "fn_id bigint, lang string, code string")


UNITS = [
    (-1, "planted/app", "a.py", "handle", ["request"], [("lookup", ["name"], 3)], "def handle(request):\n    name = request.form\n    lookup(name)\n"),
    (-2, "planted/app", "b.py", "lookup", ["key"], [("strip", [], 2), ("execute", ["text"], 3)], "def lookup(key):\n    text = key.strip()\n    return db.execute(text)\n"),
    (-3, "planted/app", "c.py", "other", ["key"], [("lookup", ["7"], 2)], "def other(key):\n    return lookup(7)\n"),
    (-4, "planted/app", "d.py", "apart", ["text"], [], "def apart(text):\n    return db.execute(text)\n"),
]


def planted_units(spark: SparkSession) -> DataFrame:
    """Units with a flow over two files: ``handle`` reads an input and passes it to ``lookup``, which runs it; nothing calls ``apart``."""
    return spark.createDataFrame(UNITS, "unit_id bigint, project string, file string, name string, params array<string>, call_sites array<struct<callee:string,args:array<string>,line:int>>, body string")


def units_sql() -> str:
    """The planted units as rows of DuckDB."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    listed = lambda xs: "[" + ", ".join(map(text, xs)) + "]::VARCHAR[]"
    sites = lambda cs: "[" + ", ".join(f"{{'callee': {text(c)}, 'args': {listed(a)}, 'line': {n}}}" for c, a, n in cs) + "]::STRUCT(callee VARCHAR, args VARCHAR[], line INTEGER)[]"
    return " UNION ALL ".join(f"SELECT {i}, {text(p)}, {text(f)}, {text(n)}, {listed(ps)}, {sites(cs)}, {text(b)}" for i, p, f, n, ps, cs, b in UNITS)
