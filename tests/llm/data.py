SMALL = "/root/testdata/sf0.001"
DOCS = f"{SMALL}/documents.parquet"
