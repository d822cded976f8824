import pytest
from conftest import rows

from tuneloom import ChatTemplate, FORMATS, cap_tokens, conversations, format_rows, get_format, map_columns

HEAD = "Below is an instruction that describes a task"
TAIL = ". Write a response that appropriately completes the request.\n\n### Instruction:\n"


def text(df, format, **options):
    return [r["text"] for r in df.transform(format_rows(format, **options)).collect()]


def test_formats_are_known_by_name():
    assert set(FORMATS) == {"alpaca", "sharegpt", "completion", "raw_text", "chat_template"}
    with pytest.raises(ValueError, match="Unknown format"):
        get_format("nonexistent")
    with pytest.raises(ValueError, match="Unknown format"):
        format_rows("nonexistent")


def test_instruction_with_and_without_input(spark):
    df = spark.createDataFrame(
        [
            ("Translate", " Hello\n", "Bonjour"),
            ("Write a poem", "", "Roses are red"),
            ("Blank", " \n 　", "x"),
            (None, None, None),
        ],
        "instruction string, input string, output string",
    ).coalesce(1)
    assert text(df, "alpaca") == [
        f"{HEAD}, paired with an input that provides further context{TAIL}Translate\n\n### Input:\nHello\n\n### Response:\nBonjour",
        f"{HEAD}{TAIL}Write a poem\n\n### Response:\nRoses are red",
        f"{HEAD}{TAIL}Blank\n\n### Response:\nx",
        f"{HEAD}{TAIL}\n\n### Response:\n",
    ]


def test_instruction_with_missing_columns(spark):
    df = spark.createDataFrame([("only",)], "instruction string")
    assert text(df, "alpaca") == [f"{HEAD}{TAIL}only\n\n### Response:\n"]


def test_completion_and_fallback_column(spark):
    df = spark.createDataFrame([("Hello, ", "world!")], "prompt string, completion string")
    assert text(df, "completion") == ["Hello, world!"]
    df = spark.createDataFrame([("Q: ", "A.")], "prompt string, response string")
    assert text(df, "completion") == ["Q: A."]
    df = spark.createDataFrame([("Q: ", None, "A.")], "prompt string, completion string, response string")
    assert text(df, "completion") == ["Q: "]
    assert text(df.select("prompt"), "completion") == ["Q: "]


def test_raw_text(spark):
    df = spark.createDataFrame([("The quick brown fox",), (None,)], "text string").coalesce(1)
    assert text(df, "raw_text") == ["The quick brown fox", ""]


def test_column_map_follows_dataset_to_canonical(spark):
    df = spark.createDataFrame([("Hello ", "world")], "prompt_text string, completion string")
    assert text(df, "completion", column_map={"prompt_text": "prompt"}) == ["Hello world"]


def test_column_map_last_column_wins(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    mapped = map_columns(df, {"a": "x", "c": "x"})
    assert mapped.columns == ["x", "b"]
    assert rows(mapped) == [(3, 2)]
    assert map_columns(df, None) is df


def test_dialogue_plain_and_templated(spark):
    df = spark.createDataFrame(
        [([("human", "Hi"), ("gpt", "Hello!"), ("tool", "x")],), ([],), (None,)],
        "conversations array<struct<from:string,value:string>>",
    ).coalesce(1)
    assert text(df, "sharegpt") == ["Human: Hi\nGpt: Hello!\nTool: x", "", ""]
    assert text(df, "sharegpt", template="role_colon") == ["user: Hi\nassistant: Hello!\ntool: x", "", ""]


def test_dialogue_role_falls_back_on_empty(spark):
    df = spark.createDataFrame(
        [([("", "human", "", "Hi"), ("assistant", "gpt", "Yes", "No"), (None, None, None, None)],)],
        "messages array<struct<role:string,from:string,content:string,value:string>>",
    )
    assert text(df, "sharegpt") == ["Human: Hi\nAssistant: Yes\n: "]


def test_dialogue_of_maps(spark):
    df = spark.createDataFrame(
        [([{"from": "human", "value": "Hi"}, {"role": "gpt", "content": "Yes"}],)], "conversations array<map<string,string>>"
    )
    assert text(df, "sharegpt") == ["Human: Hi\nGpt: Yes"]


def test_dialogue_prefers_conversations_even_when_empty(spark):
    schema = "conversations array<struct<role:string,content:string>>, messages array<struct<role:string,content:string>>"
    df = spark.createDataFrame([([], [("user", "hi")])], schema)
    assert text(df, "sharegpt") == [""]
    assert text(df, "chat_template", template="role_colon") == ["user: hi"]


def test_chat_template(spark):
    df = spark.createDataFrame(
        [([("user", "What is 2+2?"), ("human", "4")],), ([],)], "messages array<struct<role:string,content:string>>"
    ).coalesce(1)
    assert text(df, "chat_template", template="role_colon") == ["user: What is 2+2?\nhuman: 4", ""]
    assert text(df, "chat_template", template="im_tags")[0] == (
        "<|im_start|>user\nWhat is 2+2?<|im_end|>\n<|im_start|>human\n4<|im_end|>\n"
    )
    own = ChatTemplate(roles={"user": ("[Q] ", " [/Q]")}, default=("({role}) ", ""), separator=" ", bos="<s>", eos="</s>")
    assert text(df, "chat_template", template=own) == ["<s>[Q] What is 2+2? [/Q] (human) 4</s>", ""]
    with pytest.raises(ValueError, match="none was given"):
        text(df, "chat_template")
    with pytest.raises(ValueError, match="Unknown chat template"):
        format_rows("chat_template", template="nope")


def test_conversation_column_must_hold_messages(spark):
    df = spark.createDataFrame([("hi",)], "messages string")
    with pytest.raises(ValueError, match="array of messages"):
        text(df, "sharegpt")


def test_keep_columns_from_before_the_map(spark):
    df = spark.createDataFrame([(7, "a", "b")], "id int, source string, body string")
    out = df.transform(format_rows("completion", column_map={"source": "prompt", "body": "completion"}, keep=["id", "source"]))
    assert rows(out) == [(7, "a", "ab")]
    dotted = spark.createDataFrame([(7, "a")], "`meta.id` int, text string")
    assert rows(dotted.transform(format_rows("raw_text", keep=["meta.id"]))) == [(7, "a")]


def test_turns_become_ordered_conversations(spark):
    df = spark.createDataFrame(
        [(1, 1, "assistant", "b"), (2, 0, "user", "x"), (1, 0, "user", "a"), (1, 2, None, None)],
        "conv_id int, turn int, role string, text string",
    ).repartition(5)
    got = {r["conv_id"]: [tuple(m) for m in r["messages"]] for r in conversations(df).collect()}
    assert got == {1: [("user", "a"), ("assistant", "b"), (None, None)], 2: [("user", "x")]}


def test_cap_tokens(spark):
    df = spark.createDataFrame([("a  b\nc d",), ("a  b",), ("",), (None,)], "text string").coalesce(1)
    got = [tuple(r) for r in cap_tokens(df, 3).collect()]
    assert got == [("a b c", 4, True), ("a  b", 2, False), ("", 0, False), (None, 0, False)]
    with pytest.raises(ValueError):
        cap_tokens(df, 0)
