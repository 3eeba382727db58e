"""Rule tables of the feature and detection operators.

Fixed values: the vocabularies, patterns, weights and orders below must be exactly these for right results.
"""

# --- fixed values: primitive vocabulary; its order breaks ties -------------------------------------------------------
PRIMITIVES = [
    "LOOP", "BRANCH", "RECURSE", "ARITH_ADD", "ARITH_SUB", "ARITH_MUL", "ARITH_DIV", "ARITH_MOD", "COMPARE_EQ", "COMPARE_NE", "COMPARE_GT",
    "COMPARE_LT", "COMPARE_GE", "COMPARE_LE", "ASSIGN", "RETURN", "READ", "WRITE", "AGGREGATE", "FILTER", "SORT", "SEARCH", "STATE",
]

# --- fixed values: tokens that count for a primitive -----------------------------------------------------------------
TOKEN_PRIMITIVES = {
    "LOOP": ["for", "while", "foreach", "until", "repeat", "do"],
    "BRANCH": ["if", "else", "elif", "switch", "case", "when"],
    "ARITH_ADD": ["+"],
    "ARITH_SUB": ["-"],
    "ARITH_MUL": ["*"],
    "ARITH_DIV": ["/"],
    "ARITH_MOD": ["%"],
    "COMPARE_EQ": ["==", "===", "equal"],
    "COMPARE_NE": ["!=", "!=="],
    "COMPARE_GT": [">"],
    "COMPARE_LT": ["<"],
    "COMPARE_GE": [">="],
    "COMPARE_LE": ["<="],
    "ASSIGN": ["=", "+=", "-=", "*=", "/=", "%=", "<<=", ">>=", "||=", "&&="],
    "RETURN": ["return", "yield", "=>"],
    "READ": ["read", "gets", "getchar", "scanf", "cin"],
    "WRITE": ["print", "printf", "println", "puts", "cout", "write", "echo"],
    "AGGREGATE": ["sum", "reduce", "accumulate", "total", "count"],
    "FILTER": ["filter", "where", "select", "distinct"],
    "SORT": ["sort", "sorted", "orderby", "order_by"],
    "SEARCH": ["find", "indexof", "search", "contains", "includes", "locate"],
    "STATE": ["append", "push", "add", "set", "mutate", "+=", "-=", "*=", "/=", "%=", "<<=", ">>=", "||=", "&&="],
}

# --- fixed values: operators, longest first, and the token pattern -----------------------------------------------------
OPERATORS = [
    "===", "!==", "**=", "//=", "<<=", ">>=", "&&=", "||=", "??=", "<<", ">>", "<=", ">=", "==", "!=", "++", "--", "+=", "-=", "*=", "/=", "%=",
    "**", "//", "->", "=>", "&&", "||", "??", "?:", "+", "-", "*", "/", "%", "=", "<", ">", "!", "?", "&", "|", "^", "~",
]

# --- fixed values: patterns per language; a language without an entry takes the default -------------------------------
DEFAULT_PATTERNS = {
    "LOOP": [r"\bfor\b", r"\bwhile\b"],
    "BRANCH": [r"\bif\b", r"\belse\b"],
    "RETURN": [r"\breturn\b"],
    "READ": [r"\binput\(", r"\bopen\(", r"\bread\("],
    "WRITE": [r"\bprint\("],
    "ASSIGN": [r"=", r"\+= ", r"-= "],
    "AGGREGATE": [r"\bsum\(", r"\bcount\(", r"\btotal\b"],
    "FILTER": [r"\bfilter\(", r"\bwhere\b"],
    "SORT": [r"\bsort\(", r"\bsorted\("],
    "SEARCH": [r"\bfind\(", r"\bindex\(", r"\bcontains\b", r"\bin\b"],
    "STATE": [r"\+= ", r"-= ", r"\bappend\(", r"\bpush\("],
    "COMPARE_EQ": [r"==|==="],
    "COMPARE_NE": [r"!=|!=="],
    "COMPARE_GT": [r" > "],
    "COMPARE_LT": [r" < "],
    "COMPARE_GE": [r">="],
    "COMPARE_LE": [r"<="],
}
_SWITCH = [r"\bif\b", r"\belse\b", r"\bswitch\b"]
LANGUAGE_PATTERNS = {
    "python": {
        "BRANCH": [r"\bif\b", r"\belif\b", r"\belse\b"],
        "READ": [r"\binput\(", r"\bopen\(", r"\bread\(", r"\breadline", r"urlopen", r"requests\.get", r"requests\.post", r"\.get\(", r"fetch\(", r"\bget\("],
        "WRITE": [r"\bprint\(", r"\.write\(", r"requests\.post", r"\.send\(", r"\bwrite\(", r"\bemit", r"\boutput"],
    },
    "javascript": {"LOOP": [r"\bfor\b", r"\bwhile\b", r"\.forEach\(", r"\.map\("], "BRANCH": _SWITCH, "WRITE": [r"console\.log", r"\bdocument\.write"]},
    "typescript": {"LOOP": [r"\bfor\b", r"\bwhile\b", r"\.forEach\(", r"\.map\("], "BRANCH": _SWITCH, "WRITE": [r"console\.log", r"\bdocument\.write"]},
    "java": {"LOOP": [r"\bfor\b", r"\bwhile\b", r"\.forEach\("], "BRANCH": _SWITCH, "WRITE": [r"System\.out\.print"], "READ": [r"Scanner", r"\breadLine", r"\bnextInt"]},
    "c": {"LOOP": [r"\bfor\b", r"\bwhile\b", r"\bdo\b"], "BRANCH": _SWITCH, "WRITE": [r"\bprintf"], "READ": [r"\bscanf", r"\bfread", r"\bgetchar"]},
    "cpp": {"LOOP": [r"\bfor\b", r"\bwhile\b", r"\bdo\b"], "BRANCH": _SWITCH, "WRITE": [r"\bprintf"], "READ": [r"\bscanf", r"\bfread", r"\bgetchar"]},
    "csharp": {"LOOP": [r"\bfor\b", r"\bwhile\b", r"\bforeach\b", r"\bdo\b"], "BRANCH": _SWITCH, "WRITE": [r"Console\.Write"], "READ": [r"Console\.ReadLine"]},
    "go": {"LOOP": [r"\bfor\b", r"\brange\b"], "BRANCH": _SWITCH, "WRITE": [r"fmt\.Print"], "READ": [r"\bScan", r"\bReadFile"]},
    "rust": {"LOOP": [r"\bfor\b", r"\bwhile\b", r"\bloop\b"], "BRANCH": [r"\bif\b", r"\belse\b", r"\bmatch\b"], "WRITE": [r"println!", r"\bprint!"], "READ": [r"\bread_line", r"\bread_to_string"]},
    "ruby": {"LOOP": [r"\bfor\b", r"\bwhile\b", r"\.each\b", r"\bdo\b"], "BRANCH": [r"\bif\b", r"\belsif\b", r"\belse\b", r"\bcase\b"], "WRITE": [r"\bputs", r"\bprint"], "READ": [r"\bgets", r"\bFile\.read"]},
    "php": {"LOOP": [r"\bfor\b", r"\bwhile\b", r"\bforeach\b"], "BRANCH": [r"\bif\b", r"\belseif\b", r"\belse\b", r"\bswitch\b"], "WRITE": [r"\becho", r"\bprint"], "READ": [r"\$_GET", r"\$_POST", r"\bfopen"]},
    "swift": {"LOOP": [r"\bfor\b", r"\bwhile\b", r"\.forEach\("], "BRANCH": _SWITCH, "WRITE": [r"\bprint\("], "READ": [r"\breadLine", r"\bread\("]},
    "kotlin": {"LOOP": [r"\bfor\b", r"\bwhile\b", r"\.forEach\("], "BRANCH": [r"\bif\b", r"\belse\b", r"\bwhen\b"], "WRITE": [r"\bprintln"], "READ": [r"\breadLine", r"\breadln"]},
}

# --- fixed values: hints that tell a language, in order of preference --------------------------------------------------
LANGUAGE_HINTS = {
    "python": ["def ", "elif", "print(", "import ", "self."],
    "typescript": [": string", ": number", ": number[]", "interface ", "type ", "const ", "let ", "=>"],
    "javascript": ["function ", "=>", "console.log", "let ", "const ", "var ", "document."],
    "java": ["public ", "class ", "System.out", "void main", "import java", "int[]", "String[]"],
    "c": ["#include", "printf(", "int main", "malloc", "stdio.h", "int ", "char "],
    "cpp": ["#include", "std::", "cout", "int main", "->", "iostream", "vector"],
    "csharp": ["using System", "Console.WriteLine", "public class", "namespace", "Console.Write", "foreach", "int[]", "string[]"],
    "go": ["package ", "func ", "fmt.Println", ":= ", "go func"],
    "rust": ["fn ", "let mut", "println!", "impl ", "->"],
    "ruby": ["def ", "end", "puts ", "require ", "do |"],
    "php": ["<?php", "function ", "echo ", "$", "->"],
    "swift": ["func ", "print(", "let ", "var ", "import Foundation"],
    "kotlin": ["fun ", "println(", "val ", "var ", "package "],
}

# --- fixed values: coarse intents by text parts -------------------------------------------------------------------------
INTENTS = {
    "READ": ["read(", "load(", "get(", "input(", "open(", "fetch", "receive", "def "],
    "WRITE": ["return", "print(", "write(", "save(", "append(", "emit", "send(", "output"],
    "COMPARE": ["if ", "==", "!=", " < ", " > ", "max(", "min(", "compare", " is "],
    "ITERATE": ["for ", "while ", "recurs", "loop", "each", "repeat", "map("],
    "TRANSFORM": [" + ", " - ", " * ", " / ", " % ", "concat", "join(", "format", "str(", "int("],
    "AGGREGATE": ["sum(", "count(", "total", "reduce(", "accumulate", "len("],
    "FILTER": ["filter(", "where", "select", " if "],
    "SORT": ["sort(", "sorted(", "order_by", "argsort", "heapq"],
    "SEARCH": ["find(", ".index(", "search(", "contains", "lookup", "locate", " in ", "match"],
    "STATE": ["+=", "-=", "store", "update", "set(", "assign", "mutate"],
}
FINE_INTENTS = {
    "READ": ["def ", "read(", "get(", "input("],
    "WRITE": ["print(", "write(", "save(", "emit"],
    "RETURN": ["return"],
    "ASSIGN": ["=", "+=", "-="],
    "LOOP": ["for ", "while ", "range("],
    "RECURSE": ["recurs", "factorial(", "fibonacci("],
    "ARITH_ADD": [" + ", "add", "sum(", "plus", "fibonacci"],
    "ARITH_MUL": [" * ", "multiply", "product", "factorial"],
    "ARITH_SUB": [" - ", "subtract", "minus"],
    "ARITH_DIV": [" / ", "divide", "quotient"],
    "ARITH_MOD": [" % ", "modulo", "remainder"],
    "PRED_EQ": ["==", "equal", "is "],
    "PRED_GT": [" > ", "greater"],
    "PRED_LT": [" < ", "less"],
    "PRED_EVEN": ["% 2", "even", "is_even"],
    "PRED_PRIME": ["prime", "is_prime", "divisib"],
    "SORT": ["sort(", "sorted("],
    "SEARCH": ["find(", "index(", "contains", " in "],
    "FILTER": ["filter(", "where", " if "],
    "AGGREGATE": ["sum(", "count(", "total", "reduce(", "len("],
}

# --- fixed values: operations by category, and type hints ---------------------------------------------------------------
OPERATIONS = {
    "TRANSFORM:ARITH_ADD": [" + ", "add", "sum(", "plus"],
    "TRANSFORM:ARITH_MUL": [" * ", "multiply", "product", "factorial"],
    "TRANSFORM:ARITH_SUB": [" - ", "subtract", "minus"],
    "TRANSFORM:ARITH_DIV": [" / ", "divide", "quotient"],
    "TRANSFORM:ARITH_MOD": [" % ", "modulo", "remainder"],
    "TRANSFORM:STR_CONCAT": [" + ", "concat", "join("],
    "TRANSFORM:STR_UPPER": [".upper()", "uppercase"],
    "TRANSFORM:STR_LOWER": [".lower()", "lowercase"],
    "TRANSFORM:STR_SPLIT": [".split(", "split("],
    "TRANSFORM:STR_STRIP": [".strip(", "strip("],
    "TRANSFORM:STR_FORMAT": ["format", 'f"', "f'"],
    "ITERATE:LOOP_FOR": ["for ", "range("],
    "ITERATE:LOOP_WHILE": ["while "],
    "ITERATE:RECURSE": ["recurs", "factorial(", "fibonacci("],
    "ITERATE:COMPREHENSION": [" for "],
    "COMPARE:PRED_EQ": ["==", "equal", " is "],
    "COMPARE:PRED_GT": [" > ", "greater"],
    "COMPARE:PRED_LT": [" < ", "less"],
    "COMPARE:PRED_MOD0": ["% 2 == 0", "% 2 != 1", "even"],
    "COMPARE:PRED_MOD1": ["% 2 != 0", "% 2 == 1", "odd"],
    "COMPARE:PRED_PRIME": ["prime", "divisib"],
    "COMPARE:BRANCH_IF": ["if ", "else", "elif"],
    "AGGREGATE:BUILTIN_SUM": ["sum("],
    "AGGREGATE:BUILTIN_LEN": ["len("],
    "AGGREGATE:BUILTIN_COUNT": [".count(", "count("],
    "AGGREGATE:MANUAL_ACC": ["+=", "acc", "total = ", "accumulate"],
    "AGGREGATE:REDUCE": ["reduce("],
    "SEARCH:BUILTIN_INDEX": [".index("],
    "SEARCH:MANUAL_LOOP": ["for i in range", "locate", "find("],
    "SEARCH:CONTAINS": ["contains", " in ", "not in"],
    "SORT:SORT": ["sort(", "sorted("],
    "FILTER:FILTER": ["filter(", "where", " if "],
    "STATE:ASSIGN": ["=", "+=", "-="],
    "STATE:MUTATE": ["append(", "add(", "set("],
    "IO:READ": ["read(", "get(", "input(", "open(", "def "],
    "IO:WRITE": ["return", "print(", "write(", "save(", "emit"],
}
TYPE_HINTS = {
    "STR": ["'", '"', "str(", "string", "text", "msg"],
    "INT": ["int(", "number", "count", "counter", "total"],
    "LIST": ["list", "arr", "items", "nums", "values", "[]", "range("],
    "DICT": ["dict", "map", "key", "value"],
}

# --- fixed values: opposite operations and penalties --------------------------------------------------------------------
OPPOSITES = [("ARITH_ADD", "ARITH_SUB"), ("ARITH_MUL", "ARITH_DIV"), ("COMPARE_GT", "COMPARE_LT"), ("COMPARE_GE", "COMPARE_LE"), ("COMPARE_EQ", "COMPARE_NE"), ("READ", "WRITE")]
OPPOSITE_PENALTY, OPPOSITE_MOST, LITERAL_PENALTY = 0.35, 0.5, 0.30

# --- fixed values: words kept by the structural bag ----------------------------------------------------------------------
BAG_KEYWORDS = ["def", "return", "if", "else", "elif", "for", "while", "in", "and", "or", "not", "import", "from", "class", "lambda", "pass", "break", "continue", "True", "False", "None", "print", "len", "range"]

# --- fixed values: kinds of lines, first match wins ----------------------------------------------------------------------
LINE_KINDS = [
    ("LOOP", r"^(?:for|while)\b"),
    ("BRANCH", r"^(?:if|elif|else|switch|case)\b"),
    ("DEF", r"^(?:def|function|func|fun)\b"),
    ("RETURN", r"^return\b"),
    ("WRITE", r"^(?:print|console\.log|puts|echo|println)\b"),
    ("READ", r"^(?:input|read|get|open)\b"),
    ("AGGREGATE", r"\+=|=\s*\w+\s*\+"),
    ("ARITH_ADD", r"\+"),
    ("ARITH_MUL", r"\*"),
    ("COMPARE", r"<|>|==|!="),
    ("ASSIGN", r"=\s*0|=\s*\[|=\s*\{"),
    ("STATE", r"\.append|\.push|\.add"),
    ("SORT", r"sort|sorted"),
    ("SEARCH", r"find|index|contains|search"),
    ("FILTER", r"filter|where"),
]

# --- fixed values: complexity classes in order, and those of known algorithms --------------------------------------------
COMPLEXITIES = ["O(1)", "O(log n)", "O(n)", "O(n log n)", "O(n^2)", "O(n^3)", "O(2^n)"]
COMPLEXITY_WEIGHT = {"O(1)": 0.0, "O(n)": 1.0, "O(n^2)": 2.0, "O(n^3)": 3.0, "O(2^n)": 4.0}
ALGORITHM_COMPLEXITY = {"binary_search": "O(log n)", "linear_search": "O(n)", "bubble_sort": "O(n^2)", "merge_sort": "O(n log n)", "quick_sort": "O(n log n)", "fibonacci": "O(2^n)", "factorial": "O(n)", "two_sum": "O(n)", "binary_tree_traversal": "O(n)", "dijkstra": "O((V+E) log V)", "knapsack": "O(n*W)", "lru_cache": "O(1)"}
THREAD_WORDS = ["thread", "parallel", "async", "await", "multiprocess", "concurrent", "pool"]

# --- fixed values: algorithm signatures: primitives, and a pattern per feature --------------------------------------------
ALGORITHMS = [
    ("binary_search", ["LOOP", "BRANCH", "ARITH_ADD", "ARITH_SUB"], [r"//\s*2|>>\s*1|\(low\s*\+\s*high\)\s*//\s*2"]),
    ("linear_search", ["LOOP", "BRANCH", "COMPARE_EQ"], [r"for\s+\w+\s+in\s+range\s*\(\s*len"]),
    ("bubble_sort", ["LOOP", "LOOP", "BRANCH", "COMPARE_GT"], [r"for\s+.*:\s*\n\s*for\s+"]),
    ("merge_sort", ["RECURSE", "BRANCH", "COMPARE_LE"], [r"len\s*\([^)]*\)\s*//\s*2", r"merge\s*\("]),
    ("quick_sort", ["BRANCH", "LOOP", "SEARCH", "RECURSE"], [r"pivot", r"\[x for x in"]),
    ("fibonacci", ["RECURSE", "ARITH_ADD", "BRANCH"], [r"fibonacci\s*\(\s*n\s*-\s*1\s*\)\s*\+\s*fibonacci"]),
    ("factorial", ["RECURSE", "ARITH_MUL", "BRANCH"], [r"n\s*\*\s*factorial"]),
    ("two_sum", ["SEARCH", "LOOP", "BRANCH", "ASSIGN"], [r"seen\s*=|diff\s*=\s*target"]),
    ("binary_tree_traversal", ["RECURSE", "BRANCH", "SEARCH"], [r"\.left\b|\.right\b|node\.val|root\.left|root\.right"]),
    ("dijkstra", ["LOOP", "BRANCH", "ASSIGN", "SEARCH"], [r"dist\s*=|distance\s*=|heapq"]),
    ("knapsack", ["LOOP", "LOOP", "BRANCH", "ASSIGN"], [r"dp\s*=|capacity|weight"]),
    ("lru_cache", ["BRANCH", "ASSIGN", "SEARCH"], [r"cache\s*=|lru|OrderedDict"]),
]

# --- fixed values: design pattern signatures ------------------------------------------------------------------------------
PATTERNS = [
    ("singleton", ["ASSIGN", "BRANCH"], [r"__instance\s*=|_instance\s*=|getInstance\s*\(|instance\s*=\s*None"]),
    ("factory", ["ASSIGN", "RETURN"], [r"def\s+create_\w+|Factory\s*\(|def\s+make_\w+|def\s+build_\w+"]),
    ("observer", ["ASSIGN", "BRANCH"], [r"\.subscribe\s*\(|\.addListener\s*\(|\.on\s*\(|notify_observers|\.emit\s*\("]),
    ("decorator", ["ASSIGN", "RETURN"], [r"@\w+\.\w+|def\s+decorator|@staticmethod|@classmethod|@property"]),
    ("adapter", ["ASSIGN", "RETURN"], [r"def\s+adapt|Adapter\s*\(|\.adapt\s*\("]),
    ("stack", ["ASSIGN", "BRANCH"], [r"\.push\s*\(|\.pop\s*\(|stack\s*=|LIFO"]),
    ("queue", ["ASSIGN", "BRANCH"], [r"\.enqueue\s*\(|\.dequeue\s*\(|queue\s*=|FIFO|collections\.deque|\bdeque\b|\.put\s*\(|\.get\s*\(|\.popleft\s*\(|\.append\s*\([^)]*queue"]),
    ("hashmap", ["ASSIGN", "SEARCH", "BRANCH"], [r"\.get\s*\([^)]*default|dict\s*=|HashMap|seen\s*=|cache\s*=\s*\{\}"]),
    ("linked_list", ["ASSIGN", "BRANCH"], [r"\.next\s*=|\.prev\s*=|ListNode|\.head\s*=|\.tail\s*="]),
    ("tree", ["RECURSE", "BRANCH"], [r"\.left\s*=|\.right\s*=|TreeNode|\.children\s*=|root\."]),
    ("graph", ["LOOP", "BRANCH", "ASSIGN"], [r"adjacency|graph\s*=|\.neighbors|\.edges\s*="]),
    ("producer_consumer", ["LOOP", "ASSIGN"], [r"queue\.put\s*\(|queue\.get\s*\(|producer|consumer"]),
    ("thread_pool", ["ASSIGN", "LOOP"], [r"ThreadPool|Executor|\.submit\s*\(|Pool\s*\(|concurrent\.futures"]),
    ("lock", ["ASSIGN", "BRANCH"], [r"\.acquire\s*\(|\.release\s*\(|with\s+.*lock|Lock\s*\(|mutex|RLock"]),
    ("async", ["ASSIGN", "BRANCH"], [r"async\s+def|await\s+|asyncio\.|\.create_task\s*\("]),
    ("retry", ["LOOP", "BRANCH"], [r"retry|max_retries|attempts\s*=|backoff|for\s+attempt"]),
    ("circuit_breaker", ["BRANCH", "ASSIGN"], [r"circuit_breaker|trip\s*=|half_open|failure_threshold|open\s*=\s*True"]),
    ("rate_limit", ["BRANCH", "ASSIGN"], [r"rate_limit|throttle|token_bucket|leaky_bucket|min_interval"]),
    ("cache", ["ASSIGN", "BRANCH", "SEARCH"], [r"cache\s*=|lru_cache|memoiz|@cache|\.get\s*\([^)]*cache"]),
    ("pagination", ["LOOP", "BRANCH"], [r"page_size|offset\s*=|limit\s*=|paginate|per_page"]),
    ("validation", ["BRANCH", "COMPARE"], [r"validate\s*\(|is_valid|check\s*\(|assert\s+|if\s+not\s+\w+\.(?:is|startswith|endswith)"]),
    ("serialization", ["ASSIGN", "RETURN"], [r"\.to_json\s*\(|\.from_json\s*\(|serialize\s*\(|deserialize\s*\(|json\.dumps|json\.loads"]),
    ("logging", ["ASSIGN"], [r"logger\.|logging\.|log\.info|log\.error|log\.warning"]),
]

# --- fixed values: weakness rules: kind, CWE, patterns of the sink, patterns that mitigate ---------------------------------
WEAKNESSES = [
    ("SQL_INJECTION", "CWE-89", [r"execute\s*\([^)]*\+", r"query\s*=\s*[\"'][^\"']*\+", r"SELECT.*\+.*username"], [r"\?\s*\)", r"execute\s*\([^)]*,"]),
    ("XSS", "CWE-79", [r"return\s*[\"']<[^\"']*\+", r"innerHTML\s*=\s*[^;]*\+", r"<div>.*\+.*name"], [r"escape\s*\(", r"textContent"]),
    ("CMD_INJECTION", "CWE-78", [r"os\.system\s*\([^)]*\+", r"system\s*\([^)]*\+", r"subprocess.*shell\s*=\s*True"], [r"subprocess\.run\s*\(\[", r"shlex\.quote"]),
    ("PATH_TRAVERSAL", "CWE-22", [r"open\s*\([^)]*\+", r"read\s*\([^)]*\+", r"os\.path\.join\s*\([^)]*\+"], [r"basename\s*\(", r"realpath\s*\(", r"normpath\s*\("]),
    ("BUFFER_OVERFLOW", "CWE-120", [r"return\s+\w+\[[^\]]*\]", r"arr\[[^\]]*\]\s*="], [r"if\s+0\s*<=\s*\w+\s*<\s*len", r"bounds"]),
    ("DESERIALIZATION", "CWE-502", [r"pickle\.loads", r"pickle\.load\s*\(", r"yaml\.load\s*\([^)]*Loader"], [r"json\.loads", r"safe_load"]),
    ("HARDCODED_CRED", "CWE-798", [r"password\s*=\s*[\"'][^\"']+[\"']", r"passwd\s*=\s*[\"'][^\"']+[\"']", r"api_key\s*=\s*[\"'][^\"']+[\"']", r"secret\s*=\s*[\"'][^\"']+[\"']", r"connect\s*\([^)]*[\"'][^\"']+[\"']", r"login\s*\([^)]*[\"'][^\"']+[\"']"], [r"os\.environ", r"getenv", r"get_secret"]),
    ("EVAL_USE", "CWE-95", [r"\beval\s*\(", r"\bexec\s*\(", r"compile\s*\([^)]*exec"], [r"ast\.literal_eval"]),
]

# --- fixed values: sink roles and impacts --------------------------------------------------------------------------------
SINK_ROLES = {
    "CODE_EXEC": [r"\beval\s*\(", r"\bexec\s*\(", r"os\.system", r"system\s*\(", r"subprocess\.(?:call|run|Popen|check_output)", r"Runtime\.getRuntime\(\)\.exec", r"ProcessBuilder", r"ognl", r"jndi\.lookup", r"lookup\s*\(", r"run_command", r"execute_command", r"shell_exec", r"passthru", r"popen", r"proc_open", r"backtick"],
    "SQL": [r"\.execute\s*\(", r"\.query\s*\(", r"createQuery", r"rawQuery", r"SELECT\s+.*\bFROM\b", r"INSERT\s+INTO", r"UPDATE\s+\w+\s+SET", r"DELETE\s+FROM", r"\.prepareStatement", r"\.createStatement"],
    "FILE": [r"\bopen\s*\(", r"fopen\s*\(", r"readFile", r"writeFile", r"\.read\s*\(", r"\.write\s*\(", r"file_get_contents", r"file_put_contents", r"unlink", r"os\.remove", r"os\.path\.join", r"Path\s*\(", r"new\s+File\s*\("],
    "RENDER": [r"innerHTML", r"document\.write", r"\.html\s*\(", r"render\s*\(", r"\.appendChild", r"insertAdjacentHTML", r"outerHTML", r"v-html"],
    "DESERIALIZE": [r"pickle\.loads", r"pickle\.load\s*\(", r"yaml\.load\s*\(", r"yaml\.load", r"unserialize\s*\(", r"ObjectInputStream", r"readObject", r"marshal\.loads", r"json\.loads\s*\([^)]*object_hook", r"load\s*\([^)]*Loader"],
    "MEMORY": [r"\[\s*\w+\s*\]", r"\[\s*\w+\s*:\s*\w+\s*\]", r"memcpy", r"strcpy", r"strcat", r"sprintf", r"buffer\[", r"\.substring\s*\(", r"\.slice\s*\("],
}
SINK_IMPACT = {"CODE_EXEC": 1.0, "SQL": 1.0, "DESERIALIZE": 0.9, "MEMORY": 0.9, "FILE": 0.8, "RENDER": 0.7}
SINK_WORDS = {
    "CODE_EXEC": ["exec", "system", "eval", "ognl", "jndi", "shell", "popen", "passthru", "proc_open", "run_command", "command", "process", "spawn", "fork", "lookup", "invoke", "call", "backtick"],
    "SQL": ["execute", "query", "select", "insert", "update", "delete", "sql", "createquery", "rawquery", "preparestatement", "createstatement"],
    "FILE": ["open", "read", "write", "file", "fopen", "unlink", "remove", "path", "readfile", "writefile", "get_contents", "put_contents"],
    "RENDER": ["render", "html", "innerhtml", "write", "appendchild", "insertadjacent", "template", "markup"],
    "DESERIALIZE": ["pickle", "yaml", "unserialize", "deserialize", "readobject", "load", "marshal", "objectinputstream"],
    "MEMORY": ["memcpy", "strcpy", "strcat", "sprintf", "buffer", "slice", "substring", "index", "offset"],
}
ROLE_WORDS = {
    "CODE_EXEC": ["exec", "system", "eval", "shell", "popen", "spawn", "fork", "invoke", "command", "process", "run", "lookup", "jndi", "ognl"],
    "SQL": ["query", "select", "insert", "update", "delete", "sql", "execute"],
    "FILE": ["open", "read", "write", "file", "path", "unlink", "remove"],
    "RENDER": ["render", "html", "template", "markup", "innerhtml", "append", "paint", "draw", "content", "inner", "outer", "write_html", "insert"],
    "DESERIALIZE": ["load", "unserialize", "deserialize", "pickle", "yaml", "marshal", "parse", "readobject", "unpack", "decode", "hydrate", "restore", "unwrap"],
    "MEMORY": ["memcpy", "strcpy", "strcat", "sprintf", "buffer", "slice", "substring", "index", "offset"],
}
NO_CALLS = [
    "if", "for", "while", "return", "def", "function", "func", "fun", "print", "range", "len", "sum", "sorted", "import", "from", "int", "str", "float", "list",
    "dict", "set", "new", "class", "self", "this", "super", "assert", "raise", "with", "not", "and", "or", "in", "is", "lambda", "yield", "pass", "break",
    "continue", "try", "except", "finally", "else", "elif", "switch", "case", "catch", "throw", "typeof", "var", "let", "const", "void", "bool", "char",
    "double", "long", "short", "unsigned", "signed", "static", "public", "private", "protected", "package", "namespace", "using", "require", "include",
    "echo", "puts", "printf", "scanf", "console", "document", "window", "Math", "String", "Integer", "Object", "Array", "List", "Map", "Set", "File",
    "Path", "System", "Runtime", "Process", "Thread", "Exception", "Error",
]

# --- fixed values: values written into the code -----------------------------------------------------------------------------
HARDCODED = {
    "SECRET": [r"\b(?:password|passwd|pwd|api_key|apikey|secret|token)\s*=\s*[\"'][^\"']+[\"']", r"\b(?:password|passwd|pwd|api_key|apikey|secret|token)\s*[:=]\s*[\"'][^\"']+[\"']", r"(?:connect|login|auth|authenticate)\s*\([^)]*[\"'][^\"']+[\"']"],
    "SHELL_CMD": [r"os\.system\s*\(\s*[\"'][^\"']+[\"']", r"system\s*\(\s*[\"'][^\"']+[\"']", r"subprocess\.(?:call|run|Popen)\s*\(\s*[\"'][^\"']+[\"']"],
    "EVAL_STR": [r"eval\s*\(\s*[\"'][^\"']+[\"']", r"exec\s*\(\s*[\"'][^\"']+[\"']"],
    "SQL_STR": [r"execute\s*\(\s*[\"'][^\"']*SELECT", r"query\s*\(\s*[\"'][^\"']*SELECT"],
    "MAGIC_NUMBER": [r"=\s*\d{4,}"],
}

# --- fixed values: exploitability ---------------------------------------------------------------------------------------------
PUBLIC_SOURCES = ["request", "req", "ctx", "input", "argv", "os.environ", "$_GET", "$_POST", "$_REQUEST", "body", "params", "query", "form", "json", "data", "cookie", "header", "session"]
MITIGATING = ["auth", "login", "token", "sanitize", "escape", "validate", "permission", "role", "csrf", "rate.limit", "allowlist", "parameterized", "prepared", "bind", "quote", "whitelist"]
WEAKNESS_IMPACT = {
    "SQL_INJECTION": 1.0, "CMD_INJECTION": 1.0, "EVAL_USE": 1.0, "OGNL_INJECTION": 1.0, "JNDI_INJECTION": 1.0, "DESERIALIZATION": 0.9, "BUFFER_OVERFLOW": 0.9,
    "TEMPLATE_INJECTION": 0.9, "SSRF": 0.85, "PATH_TRAVERSAL": 0.8, "XXE": 0.8, "XSS": 0.7, "IDOR": 0.75, "CSRF": 0.7, "LDAP_INJECTION": 0.75,
    "HARDCODED_CRED": 0.6, "HEADER_INJECTION": 0.5, "OPEN_REDIRECT": 0.5, "INSECURE_RANDOM": 0.45, "WEAK_HASH": 0.4, "LOG_INJECTION": 0.3,
}
SEVERITY_WEIGHT = {"CRITICAL": 1.0, "HIGH": 0.7, "MEDIUM": 0.4, "LOW": 0.2}
GRADES = [(0.8, "F"), (0.6, "D"), (0.4, "C"), (0.2, "B"), (0.0, "A")]
BUG_WEIGHT = {"RETURN_IN_LOOP": 0.4, "UNDEFINED_VAR": 0.3, "UNUSED_ASSIGN": 0.15, "MISSING_RETURN": 0.15}
PROGRAM_BUG_WEIGHT = {"ARITY_MISMATCH": 0.4, "MISSING_CALLEE": 0.4, "UNUSED_FUNCTION": 0.2}

# --- fixed values: where values come from and go to ---------------------------------------------------------------------------
VALUE_SOURCES = {
    "USER_INPUT": r"\binput\s*\(|\breadline|\bstdin",
    "REQUEST": r"request\.(?:args|form|json|data|params|query)|req\.(?:query|params|body)|ctx\.(?:query|param|body)|\$_GET|\$_POST",
    "ENV": r"os\.environ|getenv",
    "CONSTANT": r"=\s*[\"'][^\"']+[\"']|=\s*\d+",
    "FILE_READ": r"\bopen\s*\([^)]*['\"]r|\.read\s*\(|readFile",
    "DB_READ": r"execute\s*\([^)]*SELECT|query\s*\([^)]*SELECT|fetchone|fetchall",
    "WEB_GET": r"requests\.get|urlopen|fetch\s*\(|\.get\s*\(",
}
VALUE_SINKS = {
    "RETURN": r"\breturn\b",
    "PRINT": r"\bprint\s*\(|console\.log|System\.out|puts\s*|echo\s*|println",
    "FILE_WRITE": r"\.write\s*\(|open\s*\([^)]*['\"][wa]|writeFile",
    "DB_WRITE": r"execute\s*\([^)]*(?:INSERT|UPDATE|DELETE)|commit\s*\(",
    "WEB_POST": r"requests\.post|\.send\s*\(|fetch\s*\([^)]*POST",
    "EMIT": r"\.emit\s*\(|yield\b|\.send\s*\(",
}

# --- fixed values: files of a project --------------------------------------------------------------------------------------------
EXTENSIONS = {
    "python": [".py"], "javascript": [".js", ".mjs", ".cjs"], "typescript": [".ts", ".tsx"], "java": [".java"], "c": [".c", ".h"],
    "cpp": [".cpp", ".cc", ".hpp"], "csharp": [".cs"], "go": [".go"], "rust": [".rs"], "ruby": [".rb"], "php": [".php"], "swift": [".swift"],
    "kotlin": [".kt", ".kts"], "sql": [".sql"], "html": [".html"], "css": [".css"], "shell": [".sh"], "json": [".json"], "yaml": [".yaml", ".yml"], "markdown": [".md"],
}
SKIPPED_DIRS = [
    "node_modules", ".git", "vendor", "dist", "build", "target", "__pycache__", ".venv", "venv", "test", "tests", "spec", "specs", "examples", "docs", "benchmark",
    "benchmarks", "third_party", "third-party", "external", "deps", "assets", "static", "coverage", ".github", "bin", "obj", "out", "migrations",
]
MOST_CHARS, MOST_FILES, HISTORY = 20_000, 500, 5
SHAPE_KEYS = 92  # name-invariant dims over which spread and skew are taken

# --- fixed values: marks of the languages in order; three specific ones stand before the others -----------------------
ADAPTER_MARKS = {
    "typescript": [": string", ": number", "interface ", "type ", "number[]"],
    "cpp": ["#include", "std::", "cout", "vector"],
    "csharp": ["using System", "Console.WriteLine", "foreach", "namespace"],
    "python": ["def ", "print(", "import "],
    "javascript": ["function ", "console.log", "=>"],
    "java": ["public ", "class ", "System.out", "int[]"],
    "c": ["#include", "printf(", "int main", "malloc"],
    "go": ["package ", "func ", "fmt.Println", ":="],
    "rust": ["fn ", "let mut", "println!", "impl "],
    "ruby": ["def ", "puts ", "require ", "do |"],
    "php": ["<?php", "function ", "echo ", "$"],
    "swift": ["func ", "print(", "import Foundation"],
    "kotlin": ["fun ", "println(", "val ", "package "],
}
