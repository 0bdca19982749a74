import re

from pyspark.sql import functions as F

from palisade.llm.surrogates import GIVEN, assign, mentions_of, replace

TEXT = ("Write to Jo.Doe@Firm.example.org or jo.doe@firm.example.org, call +1 (310) 555-4510 or +1 310 555 4510; card 4111 1111 1111 1111 and 4111111111111111. "
        'token = "e03422dad6b454724135" and password=Abc12345xy; from 10.20.30.40. Mrs Anna Schmidt met Mr. Schmidt; госпожа Анна Иванова. ssn 123-45-6789')


def out(df):
    return {r.doc_id: (r.text, r.entities) for r in df.collect()}


def luhn(s):
    d = [int(c) for c in reversed(re.sub(r"\D", "", s))]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_kinds_formats_and_coreference(docs):
    got, n = out(replace(docs([(1, TEXT), (2, "only +1 (310) 555-4510 here"), (3, "clean text 1234567890123456")]), "key"))[1]
    assert n == 13
    email = re.findall(r"[\w.]+@[\w.]+", got)
    assert email[0].lower() == email[1] and email[1].endswith((".example.com", ".example.org", ".example.net"))
    phones = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}|\+1 \d{3} \d{3} \d{4}", got)
    assert len(phones) == 2 and len({re.sub(r"\D", "", p) for p in phones}) == 1 and "3105554510" not in re.sub(r"\D", "", phones[0])
    cards = re.findall(r"\b4\d{3} \d{4} \d{4} \d{4}|\b4\d{15}", got)
    assert len(cards) == 2 and cards[0].replace(" ", "") == cards[1] != "4" + "1" * 15 and luhn(cards[1])
    assert re.search(r'token = "[0-9a-f]{20}" and password=[A-Z][a-z]{2}\d{5}[a-z]{2};', got) and "e03422" not in got
    people = re.search(r"Mrs (\w+) (\w+) met Mr\. (\w+); госпожа ([А-я]+) ([А-я]+)\.", got)
    assert people[2] == people[3] != "Schmidt" and people[1] != "Anna" and people[4] != "Анна" and people[5] != "Иванова"
    for gone in ("Doe", "10.20.30.40", "Abc12345xy", "123-45-6789"):
        assert gone not in got
    rest = lambda t: re.sub(r"\w+", "w", t)
    assert rest(got).startswith(rest("Write to ")) and got.endswith(re.search(r"ssn \d{3}-\d{2}-\d{4}$", got)[0])


def test_mentions_go_as_a_whole(docs):
    long = "Ab3" * 200
    gone = {1: (f"token={long} end", [long[500:]]), 2: ("token: eyJhbGciOi.eyJzdWIiOjE.SflKxwRJSM", ["eyJzdWIiOjE", "SflKxwRJSM"]),
            3: ("password=Pa$$w0rd!xyz ok", ["w0rd", "xyz"]), 4: ("DB_PASSWORD=hunter2hunter2", ["hunter2"]), 5: ("client_secret: 'one two three four'", ["two", "four"]),
            6: ("sk-" + long[:90], [long[30:60]]), 7: ("sk-proj-" + long[:40], [long[:40]]), 8: ("Mr John Paul Smith left", ["John", "Paul", "Smith"]),
            9: ("Maria Elena Garcia left", ["Maria", "Elena", "Garcia"]), 10: ("secret=пароль-очень", ["пароль", "очень"])}
    got = out(replace(docs([(i, t) for i, (t, _) in gone.items()]), "k"))
    for i, (text, parts) in gone.items():
        assert got[i][1] == 1 and not [p for p in parts if p in got[i][0]], (text, got[i])
    assert got[1][0].endswith(" end") and got[3][0].endswith(" ok") and got[4][0].startswith("DB_PASSWORD=") and got[5][0].endswith("'")
    assert len(got[8][0].split()) == 5 and got[8][0].startswith("Mr ") and got[8][0].endswith(" left")


def test_one_given_name_is_one_person_behind_any_title(docs):
    rows = ["Dr Anna Schmidt", "Anna Schmidt", "Mrs Anna Schmidt", "Prof. Anna Schmidt", "Herr Quentin Meyer", "Dr Quentin Meyer"]
    got = [t.split() for t, _ in (v for _, v in sorted(out(replace(docs(list(enumerate(rows))), "k")).items()))]
    assert len({tuple(t[-2:]) for t in got[:4]}) == 1 and len({tuple(t[-2:]) for t in got[4:]}) == 1
    assert got[0][1] in GIVEN["latin", "f"] and got[4][1] in GIVEN["latin", "m"] and got[0][0] == "Dr"


def test_same_over_documents_and_runs_other_with_another_key(docs):
    rows = [(i, f"mail a{i % 5}@b.example.com now") for i in range(40)]
    one, two, three = out(replace(docs(rows), "k")), out(replace(docs(rows[::-1]), "k")), out(replace(docs(rows), "other"))
    assert one == two and len({t for t, _ in one.values()}) == 5 and all(one[i][0] != three[i][0] for i in one)


def test_cases(clashing):
    rows = [(1, None), (2, ""), (3, "no one"), (4, "x " * 200_000 + "call 310-555-4510"), (5, "ip 1.2.3.4"), (5, "ip 1.2.3.4"), (None, "ip 1.2.3.4"), (6, "not.an.ip 1.2.3.4.5 a@b 4111111111111112"), (7, None)]
    df = replace(clashing(rows), "k")
    assert df.columns == [*(c for c in clashing([]).columns if c != "entities"), "entities"]
    got = sorted(((r.doc_id, r.text, r.entities, r.sig) for r in df.collect()), key=repr)
    assert len(got) == len(rows)
    by = {(g[0], g[1]): g[2] for g in got}
    assert by[1, None] == by[7, None] == by[2, ""] == by[3, "no one"] == 0 and by[6, rows[7][1]] == 0
    same = {g[1] for g in got if g[0] in (5, None)}
    assert len(same) == 1 and "1.2.3.4" not in same.pop()
    assert [g[1] for g in got if g[0] == 4][0].startswith("x x x") and by[4, [g[1] for g in got if g[0] == 4][0]] == 1
    assert replace(clashing([]), "k").count() == 0


def test_hot_identity_and_many_identities_stay_distinct(spark):
    """Far more given names than there are in the list, and short secrets that clash often."""
    kinds = [("given:latin:f", f"Name{i}") for i in range(120)] + [("given:latin:f", "Anna")] + [("surname:cyrillic", f"С{i}") for i in range(60)]
    kinds += [("ssn", f"{i:03d}") for i in range(700)]
    rows = spark.createDataFrame(kinds * 2, "kind string, identity string")
    got = assign(rows, F.lit("k")).collect()
    assert len(got) == len(kinds)
    for family in ("given", "surname", "ssn"):
        own = [r for r in got if r.kind.startswith(family)]
        assert len({r.surrogate for r in own}) == len(own)
    assert not {r.surrogate for r in got} & {i for k, i in kinds if k != "ssn"}


def test_key_is_not_in_the_plan(docs):
    df = replace(docs([(1, "ip 1.2.3.4")]), "very-secret-key")
    assert "very-secret-key" not in df._jdf.queryExecution().toString()


def test_mentions(spark):
    rows = {"a +1 (988) 555-2485 orthen": 1, "ernt 404189 9 1.2.3": 0, "A@b.c": 0, "x4111111111111111": 0, "James Brown and Brown": 1, "mail me.at@x.y.example.com.": 1}
    got = {r.t: r.n for r in spark.createDataFrame([(t,) for t in rows], "t string").select("t", F.size(mentions_of(F.col("t"))).alias("n")).collect()}
    assert got == rows


def test_names_of_any_writing(docs):
    gone = {1: ("Mrs. Anna O'Neill left", ["Anna", "O'Neill", "Neill"]), 2: ("Dr. Anna McDonald left", ["Anna", "McDonald", "Donald"]), 3: ("Herr Peter van den Berg left", ["Peter", "Berg"]),
            4: ("Señora Maria de la Cruz left", ["Maria", "Cruz"]), 5: ("MR PETER GARCIA left", ["PETER", "GARCIA"]), 6: ("Mr Bartholomew" + "x" * 60 + " left", ["x" * 20]),
            7: ("Maria-Elena Garcia-Lopez left", ["Elena", "Lopez"])}
    got = out(replace(docs([(i, t) for i, (t, _) in gone.items()]), "k"))
    for i, (text, parts) in gone.items():
        assert got[i][1] == 1 and not [p for p in parts if p in got[i][0]] and got[i][0].endswith(" left"), (text, got[i])
    assert " van den " in got[3][0] and " de la " in got[4][0] and got[5][0][:-4].isupper()
    assert got[1][0].split()[1] == got[2][0].split()[1]  # one given name, whatever the surname
    assert got[3][0].split()[1].upper() == got[5][0].split()[1]


def test_a_name_ends_before_small_words_with_a_capital(docs):
    got = out(replace(docs([(1, "Maria Went To Berlin In May"), (2, "Maria In Berlin")]), "k"))
    assert got[1][0].endswith(" To Berlin In May") and got[1][1] == 1 and got[2] == ("Maria In Berlin", 0)


def test_words_of_a_name_that_stand_alone(docs):
    text = "Mr Peter Garcia came. Garcia said no; GARCIA-led Token=abcdefgh1 and Peter too. Garcias stay."
    rows = [(1, text), (2, "Garcia and Peter came"), (3, "Mr Peter Garcia came")]
    got = out(replace(docs(rows), "k"))
    name = got[3][0].split()
    assert got[2] == (rows[1][1], 0) and got[1][1] == 4 and "abcdefgh1" not in got[1][0]
    words = got[1][0].split()
    assert words[1] == words[-4] == name[1] and words[2] == words[4] == name[2] and got[1][0].endswith("Garcias stay.")


def test_more_secrets_accounts_and_addresses(docs):
    pem = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n" + "MIIEow12+/Ab\n" * 30 + "-----END RSA PRIVATE KEY-----"
    gone = {1: (r'{"password": "ab\"cdefghij-rest"} ok', ["cdefghij", "rest"]), 2: ("Authorization: Bearer abcDEF123456.ghi-789 ok", ["abcDEF", "ghi"]), 3: (pem, ["MIIEow"]),
            4: ("DE89 3704 0044 0532 0130 00 ok", ["3704 0044", "0532"]), 5: ("to 2001:db8::ff00:42:8329 ok", ["ff00", "8329"]), 6: ("at 00:1B:44:11:3A:B7 ok", ["44:11"]),
            7: ("tel 0049 30 1234567 or +49 30 1234567 ok", ["30 1234", "1234567"]), 8: ("müller@beispiel.de ok", ["müller", "ller@", "beispiel"]),
            9: ("a" * 100 + "@b.example.com ok", ["aaaaaaaaaaaaaaaa"]), 10: ("from 2001:0db8:0000:0000:0000:ff00:0042:8329 ok", ["ff00:0042"])}
    got = out(replace(docs([(i, t) for i, (t, _) in gone.items()] + [(0, "DE89 3704 0044 0532 0130 01 and 12:30:45 std::vector bearer of news std::x86")]), "k"))
    assert got[0][1] == 0
    for i, (text, parts) in gone.items():
        assert got[i][1] == (2 if i == 7 else 1) and not [p for p in parts if p in got[i][0]], (text, got[i])
    assert got[1][0].startswith('{"password": "') and got[1][0].endswith('"} ok') and got[3][0].endswith("-----END RSA PRIVATE KEY-----")
    iban = got[4][0][:-3]
    plain = iban.replace(" ", "")
    assert [len(x) for x in iban.split()] == [4, 4, 4, 4, 4, 2] and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    a, b = re.findall(r"(?:0049|\+49) (\d\d \d+)", got[7][0])
    assert a == b and re.search(r"^at (?:[0-9A-F]{2}:){5}[0-9A-F]{2} ok$", got[6][0])


def test_a_text_full_of_mentions_and_its_copies(docs):
    text = " ".join(f"u{i}@x{i % 7}.example.com" for i in range(20_000))
    got = out(replace(docs([(1, text), (2, text)]), "k"))
    assert got[1] == got[2] and got[1][1] == 20_000 and len(set(got[1][0].split())) == 20_000
