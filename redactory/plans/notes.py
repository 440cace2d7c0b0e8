"""Texts made from the orders table: a row of every kind that the detectors know, as one SQL expression for Spark and DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from redactory.session import spread

N, C = "o_orderkey", "o_custkey"


def d(value: str, width: int) -> str:
    """Digits of a whole number, filled up on the left."""
    return f"lpad(CAST({value} AS STRING), {width}, '0')"


def s(value: str) -> str:
    return f"CAST({value} AS STRING)"


TEMPLATES = (
    f"'his PAN is ABCDE' || {d(f'{N} % 10000', 4)} || 'F for the KYC form'",
    f"'aadhaar ' || {d(N, 12)} || ' needs updating'",
    f"'the invoice total was ' || {d(N, 12)} || ' paise'",
    f"'card number 4532015112830366 or 4532 0151 1283 ' || {d(f'{N} % 10000', 4)} || ' for the form'",
    f"'the server runs on port ' || {s(f'1000 + {N} % 9000')} || ' now'",
    f"'the server prod-db-' || {d(f'{N} % 100', 2)} || ' needs a restart'",
    f"'hunter' || {s(N)} || 'isnotsecure is my password'",
    f"'see https://api' || {s(f'{N} % 50')} || '.corp.example.com:8443/path/' || {s(N)} || ' and http://example.org/x?y=1.'",
    f"'/root/.ssh/id_' || {s(N)} || ' and /dev/null or /opt/acme-' || {s(f'{N} % 7')} || '/config.yml'",
    f"'inet 192.168.' || {s(f'{N} % 256')} || '.' || {s(f'{C} % 256')} || ' netmask 255.255.255.0 ether 00:1b:44:11:3a:' || {s(f'10 + {N} % 90')}",
    f"'password = \"letmein' || {s(N)} || '\" and pwd: os.environ'",
    f"'api_key: ' || chr(39) || 'key' || {d(N, 20)} || chr(39)",
    f"'username = svc_corp_' || chr(CAST(97 + {N} % 26 AS INT)) || {s(f'{N} % 100')} || ' in the file'",
    f"'export DB_TOKEN=tok' || {d(N, 10)}",
    f"'postgres://user' || {s(N)} || ':pw' || {s(C)} || '@db.example.com/app; next'",
    f"'Server=s' || {s(f'{N} % 9')} || ';Database=d;User Id=u;Password=p' || {s(N)} || ';'",
    f"'AKIA' || {d(N, 16)} || ' then xoxb-' || {d(N, 12)} || ' then ghp_' || {d(N, 36)}",
    f"'eyJ' || {d(N, 6)} || '.abc.def paid $' || {s(N)} || '.50 or Rs. ' || {s(f'10 + {N} % 90')} || ',500'",
    f"'SBIN0' || {d(f'{N} % 1000000', 6)} || ' ssn ' || {d(f'{N} % 1000', 3)} || '-' || {d(f'{N} % 100', 2)} || '-' || {d(f'{N} % 10000', 4)}",
    f"'mail user' || {s(f'{N} % 500')} || '@example.com or call my mobile ' || {d(f'{N} + 9000000', 10)}",
    f"'aws_secret_access_key = ' || {d(N, 40)}",
    f"'sk-proj-' || {d(N, 24)} || ' and pk_live_' || {d(N, 14)}",
    f"'-----BEGIN RSA PRIVATE KEY-----' || chr(10) || {d(N, 30)} || chr(10) || '-----END RSA PRIVATE KEY-----'",
    f"'passport A' || {d(f'{N} % 100000000', 8)} || ' was renewed'",
    f"'Please ask Jane Doe about account ' || {d(N, 8)} || ', order ' || {s(f'1000 + {N} % 5000')}",
    "'nothing to see here, the total is fine'",
    f"'line one' || chr(13) || chr(10) || '   ' || chr(10) || 'my password is pw' || {d(N, 6)} || 'abcd.' || chr(10) || 'done'",
    f"'fe80::1a2b:' || {s(f'1000 + {N} % 9000')} || ' and 10.0.' || {s(f'{N} % 256')} || '.1 and 8.8.' || {s(f'{N} % 256')} || '.8'",
    f"'aadhaar 1234 5678 ' || {d(f'{N} % 10000', 4)} || ' on file'",
    f"'open C:' || chr(92) || 'Data' || chr(92) || 'bob' || {s(N)} || chr(92) || 'a.txt please'",
)
CASE = f"CASE {N} % {len(TEMPLATES)} " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(TEMPLATES)) + " END"
#: The table as SQL: note_id, session_id, text.
SQL = f"SELECT {N} AS note_id, {C} AS session_id, {CASE} AS text FROM orders"


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes, over all cores where their table is small: detection costs far more than its shuffle."""
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select(N, C))
    return orders.selectExpr(f"{N} AS note_id", f"{C} AS session_id", f"{CASE} AS text")


#: Phrase by number, and what it finds: (rule, value before words are put around it).
OTHERS = (
    ("'my drivers license is A' || {d7} || ' ok'", "contextual-drivers-license-us", "'A' || {d7}"),
    ("'the address 2001:db8::' || {n} || ' is up'", "ipv6-standalone", "'2001:db8::' || {n}"),
    ("'reach db' || {n} || '.corp.internal now'", "internal-hostname", "'db' || {n} || '.corp.internal'"),
    ("'the uid of ' || {d12} || ' changed'", "aadhaar-india-contextual", "{d12}"),
    ("'passports ' || {d9} || ' expired'", "contextual-passport-us", "{d9}"),
    ("'see /home/user' || {n} || '/notes.txt please'", "unix-file-path", "'/home/user' || {n} || '/notes.txt'"),
    ("'ping 172.16.0.' || {n} || ' twice'", "private-ip-standalone", "'172.16.0.' || {n}"),
    ("'the box web-' || {n} || '-prod is down'", "internal-hostname-contextual", "'web-' || {n} || '-prod'"),
)


def phrase_rows() -> list[tuple[str, str, str]]:
    """(text, rule, value) as SQL over n_nationkey: each conversational keyword with a value behind it, then OTHERS."""
    from redactory.functions.lexicon import PHRASES

    n = s("n_nationkey")
    fill = {"n": n, "d7": d("n_nationkey + 1000000", 7), "d9": d("n_nationkey", 9), "d12": d("n_nationkey", 12)}
    rows = []
    for phrase, _, name in PHRASES:
        value = f"'jane_d' || {n} || '.x'" if name else f"'Zx' || {n} || 'qwert99'"
        # two keywords are shadowed by others that stand before them
        rule = {"creds": "cred", "credentials": "credential"}.get(phrase, phrase)
        rows.append((f"'set {phrase} as ' || {value} || ' now'", "proximity-" + rule.replace(" ", "-"), value))
    return rows + [tuple(x.format(**fill) for x in r[:1]) + (r[1], r[2].format(**fill)) for r in OTHERS]


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text of every keyword for every nation: phrase_id, text."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey")
    texts = ", ".join(text for text, _, _ in phrase_rows())
    return nations.selectExpr("n_nationkey", f"posexplode(array({texts})) AS (i, text)").selectExpr("CAST(n_nationkey * 100 + i AS LONG) AS phrase_id", "text")
