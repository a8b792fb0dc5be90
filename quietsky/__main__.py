from quietsky.plans.application import main

main()
