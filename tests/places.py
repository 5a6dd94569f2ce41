"""Where the smallest tables are."""

SF = "/root/testdata/sf0.001"
