"""One statement, two engines: the few expressions in which Spark SQL and DuckDB differ."""

from __future__ import annotations

# Accented letters and the plain letters they fold to.
ACCENTED = "áàảãạăắằẳẵặâấầẩẫậéèẻẽẹêếềểễệíìỉĩịóòỏõọôốồổỗộơớờởỡợúùủũụưứừửữựýỳỷỹỵđ"
FOLDED = "aaaaaaaaaaaaaaaaaeeeeeeeeeeeiiiiiooooooooooooooooouuuuuuuuuuuyyyyyd"


class Dialect:
    """Expressions of one engine; ``t`` names a table of the data set."""

    def __init__(self, spark: bool, prefix: str = ""):
        self.spark, self.prefix = spark, prefix

    def t(self, name: str) -> str:
        return f"{self.prefix}{name}"

    #: Index words: runs of letters, digits and inner underscores.
    WORD = "[a-z0-9](?:[a-z0-9_]*[a-z0-9])?"

    def re(self, pattern: str) -> str:
        return f"r'{pattern}'" if self.spark else f"'{pattern}'"

    def replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.re(pattern)}, '{by}')" if self.spark else f"regexp_replace({x}, '{pattern}', '{by}', 'g')"

    def find_all(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.re(pattern)}, 0)"

    def extract(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({x}, {self.re(pattern)}, {group})"

    def matches(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE {self.re(pattern)})" if self.spark else f"regexp_matches({x}, '{pattern}')"

    def size(self, x: str) -> str:
        return f"cast(size({x}) AS BIGINT)" if self.spark else f"len({x})"

    def count(self, x: str, pattern: str) -> str:
        return self.size(self.find_all(x, pattern))

    def lines(self, x: str) -> str:
        return f"split({x}, r'\\n')" if self.spark else f"string_split({x}, chr(10))"

    def explode(self, source: str, keep: str, array: str, pos: str, value: str) -> str:
        """Rows (keep, pos from 0, value) of an array."""
        if self.spark:
            return f"SELECT {keep}, cast({pos} AS BIGINT) AS {pos}, {value} FROM {source} LATERAL VIEW posexplode({array}) x AS {pos}, {value}"
        return f"SELECT {keep}, unnest(range(0, len({array}))) AS {pos}, unnest({array}) AS {value} FROM {source}"

    def join(self, x: str, by: str, order: str) -> str:
        return f"listagg({x}, '{by}') WITHIN GROUP (ORDER BY {order})" if self.spark else f"string_agg({x}, '{by}' ORDER BY {order})"

    def tidy(self, x: str) -> str:
        """Raw normaliser: legacy glyphs, line ends, runs of blanks and of line ends."""
        nl = r"'\n'" if self.spark else "chr(10)"
        x = f"translate(coalesce({x}, ''), ' Ƣƣ§', ' Ưưđ')"
        by = lambda x, p, to: f"regexp_replace({x}, {self.re(p)}, {to}{'' if self.spark else ', ' + chr(39) + 'g' + chr(39)})"
        x = by(x, r"\r\n?", nl)
        x = by(x, r"[ \t]{2,}|\t", "' '")
        x = by(x, r"\n{3,}", f"concat({nl}, {nl})")
        return f"btrim({x}, ' \\t\\n\\r\\u000b\\u000c')" if self.spark else f"trim({x}, concat(' ', chr(9), chr(10), chr(13), chr(11), chr(12)))"

    def fold(self, x: str) -> str:
        return f"translate(lower({x}), '{ACCENTED}', '{FOLDED}')"

    def match(self, x: str) -> str:
        """Match normaliser that keeps ``_ - / . %``."""
        return f"trim({self.replace(self.fold(self.tidy(x)), '[^a-z0-9_/.%-]+', ' ')})"

    def match_words(self, x: str) -> str:
        """Match normaliser that keeps letters, digits, ``_`` and ``%``."""
        return f"trim({self.replace(self.fold(self.tidy(x)), '[^a-z0-9_%]+', ' ')})"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)" if self.spark else f"sha256({x})"

    def number(self, x: str) -> str:
        return f"try_cast({x} AS DOUBLE)"

    def dot(self, a: str, b: str) -> str:
        if self.spark:
            return f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x AS DOUBLE) * cast(y AS DOUBLE)), 0D, (s, x) -> s + x)"
        return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"

    def ci(self, pattern: str) -> str:
        """The pattern without regard to case, of all scripts."""
        return ("(?iu)" if self.spark else "(?i)") + pattern

    def lam(self, args: str, body: str) -> str:
        return f"{args} -> {body}" if self.spark else f"lambda {args}: {body}"

    def map(self, array: str, var: str, body: str) -> str:
        return f"{'transform' if self.spark else 'list_transform'}({array}, {self.lam(var, body)})"

    def keep(self, array: str, var: str, test: str) -> str:
        return f"{'filter' if self.spark else 'list_filter'}({array}, {self.lam(var, test)})"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def groups(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract_all({x}, {self.re(pattern)}, {group})"

    def tagged(self, rules: list[tuple[str, str]], x: str) -> str:
        """Array of ``tag|match`` for every match of the first group, from one pass over a column."""
        # DuckDB's rules take in the character after a match; with spaces doubled the next match still has one before it.
        wide = lambda p: x if self.spark or not p.endswith("|$)") else rf"regexp_replace({x}, '(\s)', '\1\1', 'g')"
        found = [self.map(self.groups(wide(p), p), "m", f"concat('{tag}|', m)") for tag, p in rules]
        return f"flatten({self.array(*found)})"

    def common(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})" if self.spark else f"list_intersect({a}, {b})"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})" if self.spark else f"list_distinct({a})"

    def joined(self, a: str, by: str = ",") -> str:
        """The distinct items in ascending order, as one string."""
        return f"array_join(array_sort(array_distinct({a})), '{by}')" if self.spark else f"array_to_string(list_sort(list_distinct({a})), '{by}')"

    def splits(self, x: str, pattern: str) -> str:
        return f"split({x}, {self.re(pattern)})" if self.spark else f"string_split_regex({x}, '{pattern}')"

    def sentences(self, x: str) -> str:
        """Parts between line ends and after closing marks."""
        nl = r"'$1\n'" if self.spark else "concat('\\1', chr(10))"
        g = "" if self.spark else ", 'g'"
        return self.lines(f"regexp_replace({x}, {self.re('([.?!。])[ ]+')}, {nl}{g})")

    def hex_int(self, x: str) -> str:
        return f"cast(conv({x}, 16, 10) AS BIGINT)" if self.spark else f"cast(('0x' || {x}) AS BIGINT)"

    def sha1(self, x: str) -> str:
        return f"sha1({x})"

    def json(self, x: str, key: str) -> str:
        """A value of a JSON object, as text."""
        return f"get_json_object({x}, '$.{key}')" if self.spark else f"json_extract_string({x}, '$.{key}')"

    def overlap(self, a: str, b: str) -> str:
        return f"arrays_overlap({a}, {b})" if self.spark else f"list_has_any({a}, {b})"

    def half_even(self, x: str) -> str:
        return f"bround({x}, 0)" if self.spark else f"round_even({x}, 0)"

    def gather(self, x: str, order: str) -> str:
        """The values of a group as an array in order."""
        if self.spark:
            return f"transform(array_sort(collect_list(struct({order}, {x} AS kept))), x -> x.kept)"
        return f"list({x} ORDER BY {order})"

    def part(self, a: str, first: str, n: str) -> str:
        """n items of an array from the first (1-based) on."""
        return f"slice({a}, {first}, {n})" if self.spark else f"{a}[{first}:{first} + {n} - 1]"

    def text(self, a: str, by: str) -> str:
        return f"array_join({a}, '{by}')" if self.spark else f"array_to_string({a}, '{by}')"
