"""Commands of Go sources: names, parents through chains and circles, and flags."""

import pytest

from lodestone.operators.commands import ancestors, commands

ROOT = 'package main\n\nvar rootCmd = &cobra.Command{\n\tUse: "tool",\n}\n'


def found(spark, *files):
    df = spark.createDataFrame(list(files), "path string, content string")
    return {(r["parent_path"], r["name"]): (r["flags"], r["path"], r["start_line"], r["end_line"]) for r in commands(df).collect()}


def test_nested_commands_and_flags(spark):
    clone = """package main
func init() {
	repoCmd.AddCommand(cloneCmd, pushCmd)
	cloneCmd.Flags().String("branch", "", "x")
	cloneCmd.PersistentFlags().IntVarP(&v, "level", "l", 0, "x")
	cloneCmd.Flags().BoolP(name, "no", false, "x")
	other.Flags().Bool("lost", false, "")
	cloneCmd.Other().Bool("lost", false, "")
}
var cloneCmd = &cobra.Command{Use: "clone <url>", Run: func(c *cobra.Command, a []string) { x := cobra.Command{Use: "inner"}; _ = x }}
var (
	pushCmd, unused = &cobra.Command{Short: "Use: no", Use: "push"}, 3
	typed *cobra.Command = &cobra.Command{Use: "typed"}
)
func make() *cobra.Command { return &cobra.Command{Use: "anonymous"} }
var nameless = &cobra.Command{Use: name}
"""
    got = found(spark, ("cmd/tool/root.go", ROOT), ("cmd/tool/repo.go", 'package main\nvar repoCmd = &cobra.Command{Use: "repo"}\nfunc init() { rootCmd.AddCommand(repoCmd); rootCmd.AddCommand(typed) }\n'), ("cmd/tool/clone.go", clone), ("x.go", None))
    assert got == {
        ("", "tool"): ([], "cmd/tool/root.go", 3, 5), ("tool", "repo"): ([], "cmd/tool/repo.go", 2, 2), ("tool/repo", "clone <url>"): (["branch", "level", "no"], "cmd/tool/clone.go", 10, 10),
        ("tool/repo", "push"): ([], "cmd/tool/clone.go", 12, 12), ("tool", "typed"): ([], "cmd/tool/clone.go", 13, 13), ("", "inner"): ([], "cmd/tool/clone.go", 10, 10), ("", "anonymous"): ([], "cmd/tool/clone.go", 15, 15),
    }


def test_apps_programs_and_repeats(spark):
    app = 'package main\nfunc main() {\n\tapp := &cli.App{\n\t\tName: "up",\n\t\tCommands: []*cli.Command{&cli.Command{Name: "sub"}},\n\t}\n\tc.cmd = cli.Command{Name: "push"}\n}\n'
    got = found(spark, ("a.go", app), ("cmd/srv/main.go", 'package main\nvar p = flag.String("port", "", "x")\nfunc init() { flag.BoolVar(&v, "v", false,\n"x"); log.flag.Bool("no", 1) }\n'), ("cmd/srv/b/z.go", 'package b\nvar q = flag.Int("port", 1, "x")\n'), ("lib/x.go", 'package x\nvar q = flag.Int("ignored", 1, "x")\n'))
    assert got == {("", "up"): ([], "a.go", 3, 6), ("", "sub"): ([], "a.go", 5, 5), ("", "push"): ([], "a.go", 7, 7), ("", "srv"): (["port", "v"], "cmd/srv/b/z.go", 2, 4)}


@pytest.mark.parametrize("n", [1, 12, 40])
def test_long_chains_and_circles(spark, n):
    rows = [(f"v{k}", f"v{k - 1}") for k in range(1, n)] + [("v0", f"v{min(2, n - 1)}")] if n > 1 else [("v0", "v0")]
    got = {r["var"]: r["above"] for r in ancestors(spark.createDataFrame(rows, "var string, parent string")).collect()}
    parent = dict(rows)
    for var in parent:
        want, at = [], parent[var]
        while at and at not in want:
            want.append(at)
            at = parent.get(at)
        assert got[var] == want, var
    assert ancestors(spark.createDataFrame([], "var string, parent string")).count() == 0


def test_chain_of_files_takes_few_rounds(spark, monkeypatch):
    from lodestone.operators import commands as module

    rounds, stored = [], module.stored
    monkeypatch.setattr(module, "stored", lambda df, name: rounds.append(name) or stored(df, name))
    files = [("r.go", ROOT)] + [(f"f{k:02}.go", f'package p\nvar c{k} = &cobra.Command{{Use: "u{k}"}}\nfunc init() {{ {f"c{k - 1}" if k else "rootCmd"}.AddCommand(c{k}) }}\n') for k in range(30)]
    got = found(spark, *files)
    assert ("/".join(["tool"] + [f"u{k}" for k in range(29)]), "u29") in got and len(got) == 31
    assert rounds.count("commands-chains") <= 8
