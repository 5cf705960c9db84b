from weftgraph.operators import linearize


def chains(spark, spaces, mixins):
    n = spark.createDataFrame(spaces, "name string, kind string, superclass string")
    m = spark.createDataFrame(mixins, "name string, ord int, kind string, target string")
    return {r["name"]: (r["state"], r["chain"]) for r in linearize.linearize(n, m).collect()}


def test_null_targets_and_repeated_namespaces(spark):
    spaces = [("Object", "Class", None), ("M", "Module", None), ("M", "Module", None), ("Foo", "Class", None), ("Foo", "Class", "Object"), ("Sub", "Class", "Foo"), (None, "Class", "Object")]
    got = chains(spark, spaces, [("Foo", 0, "include", None), ("Foo", 1, "include", "M")])
    assert got == {"Foo": ("complete", ["Foo", "M", "Object"]), "M": ("complete", ["M"]), "Object": ("complete", ["Object"]), "Sub": ("complete", ["Sub", "Foo", "M", "Object"])}


def test_merging_and_partial_chains(spark):
    spaces = [
        ("BasicObject", "Class", None), ("Kernel", "Module", None), ("Object", "Class", "BasicObject"), ("Foo", "Class", "Object"), ("Bar", "Class", "Foo"), ("Pre", "Module", None), ("PreIn", "Module", None), ("Inc", "Module", None), ("IncIn", "Module", None),
        ("A", "Module", None), ("B", "Module", None), ("C", "Module", None), ("Fan", "Module", None), ("Me", "Module", None), ("Part", "Class", "Missing"), ("Mix", "Class", "Object"),
    ]
    mixins = [("Object", 0, "include", "Kernel"), ("Bar", 0, "prepend", "Pre"), ("Bar", 1, "include", "Inc"), ("Pre", 0, "prepend", "PreIn"), ("Inc", 0, "include", "IncIn"), ("B", 0, "include", "A"), ("C", 0, "include", "A"), ("Fan", 0, "include", "B"), ("Fan", 1, "include", "C"), ("Me", 0, "include", "Me"), ("Mix", 0, "include", "Gone"), ("Mix", 1, "include", "A"), ("Foo", 0, "include", "A"), ("Foo", 1, "include", "A")]
    got = {k: (s, " ".join(c)) for k, (s, c) in chains(spark, spaces, mixins).items()}
    want = {
        "Object": "Object Kernel BasicObject", "Foo": "Foo A Object Kernel BasicObject", "Bar": "PreIn Pre Bar Inc IncIn Foo A Object Kernel BasicObject", "Pre": "PreIn Pre",
        "Inc": "Inc IncIn", "B": "B A", "C": "C A", "Fan": "Fan C B A", "Me": "Me",
    }
    assert {k: got[k] for k in want} == {k: ("complete", c) for k, c in want.items()}
    assert got["Part"] == ("partial", "Part ?Missing Object Kernel BasicObject") and got["Mix"] == ("partial", "Mix A ?Gone Object Kernel BasicObject")


def test_cycles_keep_what_else_is_mixed_in(spark):
    spaces = [("Object", "Class", None), ("X", "Class", "Y"), ("Y", "Class", "Z"), ("Z", "Class", "X"), ("A", "Module", None), ("Foo", "Module", None), ("Bar", "Module", None), ("Above", "Class", "Z"), ("User", "Class", "Object"), ("P", "Module", None), ("Q", "Module", None)]
    mixins = [("Foo", 0, "include", "A"), ("Foo", 1, "include", "Bar"), ("Bar", 0, "include", "Foo"), ("User", 0, "include", "Bar"), ("P", 0, "prepend", "Q"), ("Q", 0, "include", "P"), ("Z", 0, "include", "A")]
    got = {k: (s, " ".join(c)) for k, (s, c) in chains(spark, spaces, mixins).items()}
    assert {k: got[k] for k in ("X", "Y", "Z")} == {"X": ("cyclic", "X Y Z A Object"), "Y": ("cyclic", "Y Z A X Object"), "Z": ("cyclic", "Z A X Y Object")}
    assert got["Foo"] == ("cyclic", "Foo Bar A") and got["Bar"] == ("cyclic", "Bar Foo A")
    assert got["Above"] == ("cyclic", "Above Z A X Y Object") and got["User"] == ("cyclic", "User Bar Foo A Object")
    assert got["P"] == ("cyclic", "Q P") and got["Q"] == ("cyclic", "Q P") and got["A"] == ("complete", "A")
