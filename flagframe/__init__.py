"""flagframe: flags, rules, masking, corpus reports and job states on Spark tables."""
