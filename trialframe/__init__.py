"""trialframe: paired-trial evaluation, ordered sequences and text scoring as lazy Spark plans."""
