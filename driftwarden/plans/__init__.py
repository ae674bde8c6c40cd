"""Plan shapes that several operators share: size checks, ranks and prefix sums, hash draws."""
